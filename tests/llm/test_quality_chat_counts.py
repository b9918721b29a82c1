import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from keyloom.llm import registry
from keyloom.llm.chat import CONTROL, TEMPLATE, TemplateError, compile_template, escape, fold, format_conversations, parse, read_back, unescape
from keyloom.llm.quality_classifier import co_train, fit, score
from keyloom.llm.quality_rules import FEATURES, judged, minimum_determinant
from keyloom.llm.token_counts import Counter, count_tokens, rank_scores
from tests.llm.helpers import SF, odd_documents, same_as_sql

PIECES = public_tokenizers.path("piece_bpe_32k.model")


# -- quality rules


def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def features(counts):
    ratio = lambda a, b: a / b if b else 0.0
    return np.array([[np.log1p(n), np.log1p(ratio(c, n)), ratio(s, c) ** 0.5, ratio(d, k) ** 0.5, ratio(r, n) ** 0.5] for n, c, s, d, r, k in counts])


def many_starts(x, floors, share=0.75, starts=200, seed=0):
    """An independent search for the least determinant: random starts, plain steps on exact ranks, no pool and no grid."""
    rnd, h, best = np.random.default_rng(seed), int(np.ceil(share * len(x))), None
    for _ in range(starts):
        pick = rnd.choice(len(x), size=min(len(x), 6), replace=False)
        was = None
        while True:
            m, cov = x[pick].mean(0), np.cov(x[pick].T, bias=True) + np.diag(floors**2)
            det = np.linalg.slogdet(cov)[1]
            if len(pick) == h and was is not None and was - det < 1e-9:
                break
            was = det if len(pick) == h else None
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(cov), x - m)
            pick = np.argsort(d2, kind="stable")[:h]
        if best is None or det < best[0]:
            best = (det, m, cov)
    return best


def test_quality_rules_counts_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    got = {r.doc_id: r for r in registry.op7_quality_rules(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r, c = got[d.doc_id], brute_counts(d.text)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (*c[:5], failed) and not (failed and r.kept)
    passed = [r for r in got.values() if not r.base_failed]
    assert 0 < sum(not r.kept for r in passed) < 0.2 * len(docs)


def clouds(seed=4):
    """Groups of 400, 150 and 40 rows, a quarter of each a tight cluster away from the rest."""
    rnd = np.random.default_rng(seed)
    mixed = np.array([[0.5, 0, 0, 0, 0], [0.1, 0.1, 0, 0, 0], [0, 0.02, 0.05, 0, 0], [0, 0, 0.01, 0.1, 0], [0, 0, 0, 0.02, 0.08]])
    out = {}
    for name, n in (("a", 400), ("b", 150), ("c", 40)):
        body = rnd.normal(size=(n * 8 // 10, 5)) @ mixed.T + np.array([6.0, 1.8, 0.1, 0.1, 0.1])
        odd = rnd.normal(size=(n - len(body), 5)) * 0.02 + np.array([9.0, 2.6, 0.9, 0.9, 0.5])
        out[name] = np.concatenate([body, odd])
    return out


def test_determinants_are_as_small_as_those_of_many_random_starts(spark):
    groups, floors = clouds(), np.array([*FEATURES.values()])
    rows = [("en", g, *map(float, x)) for g, xs in groups.items() for x in xs]
    train = spark.createDataFrame(rows, "lang string, grp string, f0 double, f1 double, f2 double, f3 double, f4 double").repartition(5)
    got = {r.grp: r for r in minimum_determinant(train, pool=0)[0].collect()}
    for g, x in groups.items():
        det, m, cov = many_starts(x, floors)
        assert got[g].det <= det + 0.1
        assert np.abs(np.array([got[g][f"m{i}"] for i in range(5)]) - m).max() < 0.15


def test_estimates_go_over_smoothly_from_the_pool_to_the_group(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(2000, 5)) * 0.1
    far = []
    for n in (5, 99, 101, 1000):
        rows = [("en", "big", *map(float, x)) for x in base] + [("en", "own", *map(float, x + 1)) for x in rnd.normal(size=(n, 5)) * 0.1]
        train = spark.createDataFrame(rows, "lang string, grp string, f0 double, f1 double, f2 double, f3 double, f4 double")
        far.append({r.grp: r.m0 for r in minimum_determinant(train, pool=30)[0].collect()}["own"])
    assert 0 < far[0] < 0.5 and far[0] < far[1] and far[-1] > 0.9 and abs(far[2] - far[1]) < 0.05


def test_quality_rules_cases(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n\t", "a b c d e f g h a b c d e f g h", "x " * 5000, "l\nl\n \n\nl é#|", "one two three four five six seven eight " * 3 + "z"]
    texts += [" ".join(rnd.choices(["a", "b"], k=60)) for _ in range(20)] + ["w" * 100_000, " ".join(str(i) for i in range(20_000))]
    rows = [(i if i % 5 else None, t) for i, t in enumerate(texts)] * 2
    kinds = "doc_id long, text string, lang string, source string, kept boolean, grp string, d2 double, words string"
    df = spark.createDataFrame([(*r, None if i % 3 else "en", None if i % 2 else "s", True, "g", 0.0, "w") for i, r in enumerate(rows)], kinds)
    got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in judged(df).collect()]
    expected = [(*c[:5], c[0] < 20 or 100 * c[4] > 30 * c[0]) for c in (brute_counts(t) for _, t in rows)]
    assert sorted(got) == sorted(expected)
    assert judged(df.limit(0)).count() == 0
    assert judged(df.where("text is null")).where("kept").count() == 0


def test_quality_rules_reject_each_extreme_alone(spark):
    rnd = random.Random(9)
    some = lambda n: [f"w{rnd.randrange(10**6):06d}" for _ in range(n)]
    plain = [" ".join(some(rnd.randrange(200, 400))) for _ in range(300)]
    lines = [" ".join(some(4)) for _ in range(27)]
    passage = some(40)
    odd = [
        " ".join(some(20_000)),
        " ".join(x * 9 for x in some(300)),
        " ".join("#$%" + x for x in some(300)),
        "\n".join(lines[i * step % 27] for step in (1, 2, 4) for i in range(27)),
        " ".join(passage + some(220) + passage),
    ]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(plain + odd)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in judged(df).collect()}
    assert not any(got[300 + i].base_failed or got[300 + i].kept for i in range(5))
    assert sum(got[i].kept for i in range(300)) > 295


# -- quality classifier


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 4 <> 0"))
    r = score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").selectExpr("kept", "quality = 1 AND toxic = 0 AS clean", "toxic = 1 AS toxic", "quality = 0 AS junk").toPandas()
    assert len(r) > 500
    assert r[r.clean].kept.mean() > 0.97 and r[r.junk].kept.mean() < 0.1 and r[r.toxic].kept.mean() < 0.35
    assert (r.kept == r.clean).mean() > 0.93


def test_classifier_cases(spark):
    docs = odd_documents(spark, [(i, "good words here today " * 5 if i % 2 else "bad junk $$$ %%% " * 9) for i in range(40)] + [(None, None), (50, ""), (51, "y " * 60_000), (51, "y")])
    docs = docs.selectExpr("*", "'en' AS lang", "cast(null AS string) AS source", "1 AS p_bad")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(3, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    got = score(docs, model, carry=True).collect()
    assert len(got) == 44 and all(r.kept == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    assert all(r.row.doc_id == r.doc_id and r.row["class"] == "z" for r in got)
    assert fit(docs, labels.where("quality = 1 and toxic = 0")) is None and fit(docs, labels.limit(0)) is None
    assert score(docs, None).where("kept").count() == 44 and score(docs.limit(0), model).count() == 0
    assert co_train([(b"a", None, None, 0), (b"b", None, None, 0)]) is None


def test_toxic_and_junk_are_caught_separately(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit(docs, labels.where("doc_id % 4 <> 0"))
    r = score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").selectExpr("kept", "toxic = 1 AS toxic", "quality = 0 AS junk").toPandas()
    assert r[r.toxic].kept.mean() < 0.1 and r[r.junk].kept.mean() < 0.1
    assert [t.name for t in model.targets] == ["low", "toxic"] and all(0 < t.limit <= 0.5 for t in model.targets)


def test_every_sure_unlabelled_row_teaches(spark):
    """Words that only unlabelled documents have, each in twelve of 9600, are learned from what their records say."""
    rnd = random.Random(8)
    rows = []
    for i in range(400):
        rows.append((i, f"{'fine words stand here' if i % 2 else 'cheap pills offer now'} {rnd.randrange(50)}", "en", "good" if i % 2 else "spam"))
    word = lambda j, bad: f"{'zq' if bad else 'wy'}{hashlib.md5(str(j).encode()).hexdigest()[:10]}"
    for i in range(9600):
        rows.append((1000 + i, f"some text {word(i // 24, i % 2)} ends", "en", "spam" if i % 2 else "good"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int"))
    p = model.score([f"some text {word(j, bad)} ends".encode() for j in range(400) for bad in (0, 1)], [None] * 800, [None] * 800)[0]
    assert (p[1::2] > p[::2]).all()


# -- chat


def test_chat_query_matches_sql(spark):
    same_as_sql(registry.op9_chat(spark, SF), registry.OP9_SQL)


def test_escape_is_reversible():
    rnd = random.Random(4)
    bits = [*CONTROL, *"\\<[|/s>INST]", "\\\\", "a", "é", "\n", "</"]
    for _ in range(3000):
        s = "".join(rnd.choices(bits, k=rnd.randrange(12)))
        e = escape(s)
        assert unescape(e) == s and not any(c in e for c in CONTROL)


def test_template_compiler():
    run = lambda t, **env: "".join(x for x, _ in compile_template(t)(env) if x != "\0")
    assert run("a{% if 'x' ~ 'y' == 'xy' and not false %}b{% else %}{{ no.such }}{% endif %}c") == "abc"
    assert fold(parse("a{% if 1 == 2 %}b{% elif true %}{{ 'q' | upper }}{% endif %}c")) == ("block", [("text", "aQc")])
    assert fold(parse("{{ x or ('a' + 'b') }}")) == ("block", [("put", ("or", ("name", "x"), ("const", "ab")))])
    assert run("{% for m in xs %}{{ m['k'] if m.k else 'none' }};{% endfor %}", xs=[{"k": "v"}, {}]) == "v;none;"
    pieces = [*compile_template("{% generation %}{{ a }}{% endgeneration %}{{ a }}")({"a": "z"})]
    assert pieces == [("z", True), ("z", False)]
    for bad in ("{% for %}", "{% if 1 %}", "{{ a(1) }}", "{{ 'a' | nofilter }}", "{% endif %}", "{{ }}", "{{ 1 + 'a' }}", "{{ a b }}"):
        with pytest.raises(TemplateError):
            compile_template(bad)
    for bad in ("{{ a.__class__ }}", "{{ b }}"):
        with pytest.raises(TemplateError):
            run(bad, a="text")


@pytest.mark.parametrize("part_turns", [2, 1024])
def test_chat_cases(spark, part_turns):
    rows = [(1, 0, "user", "hi <|im_end|> \\ [INST]"), (1, 1, "assistant", "yo</s>"), (1, 1, "assistant", "yo</s>"), (1, None, None, None), (None, 0, "assistant", "x" * 50_000), (2, 5, "user", ""), (2, 3, "tool", "t"), (3, 0, "assistant", "a"), (3, 1, "assistant", "<|im_sep|>b"), (3, 1, "assistant", "é")]
    df = spark.createDataFrame([(*r, "f", 1, None) for r in rows], "conv_id long, turn long, role string, text string, formatted string, part int, loss string")
    got = {r.conv_id: r for r in read_back(format_conversations(df, part_turns=part_turns)).collect()}
    low = lambda x: (x is not None, x or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3])))
        loss = "".join(t or "" for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in turns)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 4 and read_back(format_conversations(df.limit(0))).count() == 0
    plain = format_conversations(df, "B{% for m in messages %}{{ m.text }}{% endfor %}E", part_turns=part_turns).where("conv_id = 2").orderBy("part").collect()
    assert "".join(r.formatted for r in plain) == "BtE" and "generation" in TEMPLATE


def test_chat_keeps_nul_texts_and_refuses_a_second_loop(spark):
    rows = [(1, i, "user", "\0") for i in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = format_conversations(df, "{% for m in messages %}{{ m.text }}{% endfor %}", part_turns=2).orderBy("part").collect()
    assert [r.formatted for r in out if r.formatted] == ["\0\0", "\0\0"]
    twice = "{% for m in messages %}{{ m.text }}{% endfor %}" * 2
    with pytest.raises(Exception, match="looped over once"):
        format_conversations(df, twice).collect()


# -- token counts


def brute_count(word, scores, byte, longest):
    best = [(0, 0)]
    for i, c in enumerate(word):
        n = len(c.encode())
        best.append(max([(best[i][0] + n * byte, best[i][1] - n)] + [(best[j][0] + scores[word[j : i + 1]], best[j][1] - 1) for j in range(max(0, i + 1 - longest), i + 1) if word[j : i + 1] in scores]))
    return -best[-1][1]


def test_trie_counts_match_separate_dynamic_programs(monkeypatch):
    monkeypatch.setattr("keyloom.llm.token_counts._NODES", 50)
    monkeypatch.setattr("keyloom.llm.token_counts._WORDS", 7)
    scores = rank_scores(["a", "▁a", "ab", "b", "bab", "▁", "aba", "abab", "▁ab", "é"])
    counter, rnd = Counter(scores), random.Random(6)
    for _ in range(2000):
        w = "".join(rnd.choices("ababéc", k=rnd.randrange(1, 12)))
        assert counter.count([w.encode()]) == brute_count("▁" + w, scores, counter.byte, counter.longest)


def test_token_counts_query_and_cases(spark):
    from keyloom.llm.token_counts import sentencepiece_scores

    scores = sentencepiece_scores(PIECES)
    byte, longest = Counter(scores).byte, max(map(len, scores))
    memo = {}
    one = lambda w: memo[w] if w in memo else memo.setdefault(w, brute_count("▁" + w, scores, byte, longest))
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in registry.op10_token_counts(spark, SF).collect()}
    assert got == {d: (len(words(t)), sum(map(one, words(t)))) for d, t in docs.items()}
    df = odd_documents(spark, [(1, None), (1, ""), (None, "the 日本 \U0001f600"), (2, "a" * 3000)])
    out = sorted(((r.doc_id or 0), r.n_words, r.n_tokens) for r in count_tokens(df, PIECES).collect())
    assert out == [(0, 3, sum(map(one, ["the", "日本", "\U0001f600"]))), (1, 0, 0), (1, 0, 0), (2, 1, one("a" * 3000))]
    assert count_tokens(df.limit(0), PIECES).count() == 0


def test_long_pre_tokens_take_a_bounded_trie(monkeypatch):
    monkeypatch.setattr("keyloom.llm.token_counts._DEEP", 12)
    scores = rank_scores(["a", "▁a", "ab", "b", "bab", "▁", "aba", "abab", "▁ab", "é"])
    counter, rnd = Counter(scores), random.Random(6)
    for n in (11, 12, 13, 40, 3000):
        for _ in range(20):
            word = "".join(rnd.choices("abéc", weights=[5, 5, 1, 1], k=n))
            assert counter.count([word.encode()]) == brute_count("▁" + word, scores, counter.byte, counter.longest)
    assert counter.nodes < 12 * 101


def test_fit_takes_the_least_of_rows_that_repeat_an_id(spark):
    rnd = random.Random(4)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(good if i % 2 else bad, k=30)), "en", "s") for i in range(80)]
    again = [(i, "zzz " + " ".join(rnd.choices(bad if i % 2 else good, k=30)), None, None) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 0, 1), (999, 0, 1)], "doc_id long, quality int, toxic int")
    kinds = "doc_id long, text string, lang string, source string"
    plain, both = spark.createDataFrame(rows, kinds), spark.createDataFrame(again + rows, kinds)
    models = [fit(docs, labels) for docs in (plain, both.repartition(7), both.repartition(2))]
    one, two, three = ({r.doc_id: round(r.p_bad, 6) for r in score(plain, m).collect()} for m in models)
    assert one == two == three and all((p > 0.5) == (d % 2 == 0) for d, p in one.items())
