"""Named functions over rows (the server-side function surface), and optimistic transactions over a log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import glob_regex


@dataclass
class Functions:
    """Libraries of functions by name. A function takes columns and gives a column: a native expression where it can be one, else a
    pandas function, which runs on Arrow batches. A library is replaced only when asked."""

    libraries: dict[str, dict[str, tuple[Callable[..., Column], bool]]] = field(default_factory=dict)

    def load(self, library: str, functions: dict[str, Callable[..., Column]], replace: bool = False, read_only: tuple[str, ...] = ()) -> None:
        taken = {f: lib for lib, fs in self.libraries.items() for f in fs if lib != library}
        clash = [f for f in functions if f in taken]
        if library in self.libraries and not replace or clash:
            raise ValueError(f"already there: {clash or library}")
        self.libraries[library] = {name: (f, name in read_only) for name, f in functions.items()}

    def delete(self, library: str) -> None:
        if library not in self.libraries:
            raise ValueError(f"no library {library}")
        del self.libraries[library]

    def list(self, pattern: str = "*") -> list[tuple[str, str, bool]]:
        """(library, function, read only) of libraries that match a glob."""
        import re

        test = re.compile(glob_regex(pattern))
        return [(lib, f, ro) for lib, fs in sorted(self.libraries.items()) if test.match(lib) for f, (_, ro) in sorted(fs.items())]

    def flush(self) -> None:
        self.libraries.clear()

    def dump(self) -> str:
        """The libraries as text, for ``restore``. Only functions that are SQL text can go."""
        import json

        text = {lib: {name: [f.body, ro] for name, (f, ro) in fs.items()} for lib, fs in self.libraries.items()}
        return json.dumps(text, sort_keys=True)

    def restore(self, dumped: str, policy: str = "APPEND") -> None:
        """Libraries of a dump: APPEND refuses names that are taken, REPLACE puts the new ones in their place, FLUSH begins anew. All
        of a dump goes in, or nothing."""
        import json

        new = {lib: {name: (SqlFunction(body), ro) for name, (body, ro) in fs.items()} for lib, fs in json.loads(dumped).items()}
        old = {} if policy == "FLUSH" else dict(self.libraries)
        if policy == "APPEND" and (clash := sorted(set(old) & set(new))):
            raise ValueError(f"already there: {clash}")
        names = [f for lib, fs in {**old, **new}.items() for f in fs]
        if len(names) != len(set(names)):
            raise ValueError("a function is in two libraries")
        self.libraries = {**old, **new}

    def stats(self) -> dict[str, int]:
        return {"libraries": len(self.libraries), "functions": sum(map(len, self.libraries.values()))}

    def call(self, name: str, *args: Column, read_only: bool = False) -> Column:
        for fs in self.libraries.values():
            if name in fs:
                f, ro = fs[name]
                if read_only and not ro:
                    raise ValueError(f"{name} may write")
                return f(*args)
        raise ValueError(f"no function {name}")


@dataclass
class Scripts:
    """Scripts by the digest of their text. A script is a SQL expression over the columns of a row and its arguments, ``argv1`` and
    so on: it compiles to native code and can neither loop nor write."""

    bodies: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def digest(body: str) -> str:
        import hashlib

        return hashlib.sha1(body.encode()).hexdigest()

    def load(self, body: str) -> str:
        self.bodies[self.digest(body)] = body
        return self.digest(body)

    def exists(self, *digests: str) -> list[int]:
        return [int(d.lower() in self.bodies) for d in digests]

    def show(self, digest: str) -> str:
        if digest.lower() not in self.bodies:
            raise ValueError("no such script")
        return self.bodies[digest.lower()]

    def flush(self) -> None:
        self.bodies.clear()

    def eval(self, df: DataFrame, body: str, args: list | None = None, out: str = "result") -> DataFrame:
        """Rows with the script's value; the script is kept."""
        return self.evalsha(df, self.load(body), args, out)

    def evalsha(self, df: DataFrame, digest: str, args: list | None = None, out: str = "result") -> DataFrame:
        named = {f"argv{i}": F.lit(a) for i, a in enumerate(args or [], start=1)}
        return df.withColumns(named).withColumn(out, F.expr(self.show(digest))).drop(*named)

    def debug(self, df: DataFrame, body: str, args: list | None = None) -> str:
        """The plan that a script would run as."""
        return self.evalsha(df, self.load(body), args)._jdf.queryExecution().toString()


def kill(spark, group: str) -> None:
    """End the jobs of a group (``spark.sparkContext.setJobGroup``): a script or function that runs too long."""
    spark.sparkContext.cancelJobGroup(group)


class SqlFunction:
    """A function whose text is a SQL expression over columns of the names of its parameters. It can be dumped and restored."""

    def __init__(self, body: str):
        self.body = body

    def __call__(self) -> Column:
        return F.expr(self.body)


def pandas_function(returns: str) -> Callable:
    """A function of pandas series as a function of columns."""
    return lambda f: F.pandas_udf(f, returns)


def execute(log: DataFrame, batch: DataFrame, watches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log after, outcome) of transactions: rows (tx, key, version, val) go in unless a key that the transaction watches has
    changed: ``watches`` are (tx, key, version), as read. Outcome: (tx, done)."""
    now = log.groupBy("key").agg(F.max("version").alias("_now"))
    broken = watches.join(now, "key", "left").where(~F.col("version").eqNullSafe(F.col("_now"))).select("tx").distinct()
    done = batch.join(broken, "tx", "left_anti")
    outcome = batch.select("tx").distinct().join(broken.withColumn("_b", F.lit(True)), "tx", "left").select("tx", F.col("_b").isNull().alias("done"))
    return log.unionByName(done.select(*log.columns)), outcome
