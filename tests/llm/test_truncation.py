import random

import numpy as np
import pytest

from graphloom.llm import truncation as T

SCHEMA = "doc_id bigint, text string, source string, ending string, h string"
SUBJECTS = ["the parser", "a listener", "our cache", "the old route", "each model", "this job", "the queue", "a binding"]
VERBS = ["rejects", "copies", "reads", "forgets", "returns", "sorts", "splits", "merges"]
OBJECTS = ["every record", "the last page", "its own key", "two empty lines", "the whole table", "nothing at all", "a longer name", "one more item"]


def sentence(rng):
    s = f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)} and {rng.choice(VERBS)} {rng.choice(OBJECTS)}"
    return s[0].upper() + s[1:] + "."


def corpus(rng, n, limit=400):
    rows, cut = [], set()
    for i in range(n):
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 9)))
        if rng.random() < 0.2:
            text += "\n\n- drop " + rng.choice(OBJECTS)
        if len(text) > limit and i % 2:
            text = text[:limit]
            if text[-1] not in ".":
                cut.add(i)
        elif rng.random() < 0.04:
            text = text[: rng.randint(20, len(text) - 3)]
            if not text.rstrip().endswith("."):
                cut.add(i)
        rows.append((i, text, rng.choice(["News", "news ", "NEWS"]), "x", "x"))
    return rows, cut


def test_planted_cuts_are_found(spark):
    rows, cut = corpus(random.Random(2), 3000)
    extra = [(90_000, None, "news", "", ""), (90_001, "", "news", "", ""), (90_002, "  \n", None, "", ""), (90_003, "Only one sentence.", None, "", "")]
    judged = T.truncated(spark.createDataFrame(rows + extra, SCHEMA))
    got = {r["doc_id"]: r["truncated"] for r in judged.collect()}
    assert set(got) == {r[0] for r in rows} | {90_003}
    found = {i for i, t in got.items() if t}
    assert len(found & cut) / len(cut) > 0.9 and len(found & cut) / len(found) > 0.9
    rates = {r["source"]: r for r in T.truncation_rates(judged).collect()}
    assert set(rates) == {"news", None} and rates["news"]["documents"] == 3000
    assert rates["news"]["rate"] == pytest.approx(len(cut) / 3000, abs=0.02)


def test_empty_table(spark):
    assert T.truncated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_limits_and_censored_fit():
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(5, 0.7, 20_000)).astype(int)
    x = np.minimum(x, 300)
    lengths, counts = np.unique(x[x > 0], return_counts=True)
    limits = T.candidate_limits(lengths, counts)
    assert limits == [300]
    mu, sigma, posterior = T.fit_censored(lengths, counts, limits)
    assert mu == pytest.approx(5, abs=0.05) and sigma == pytest.approx(0.7, abs=0.05) and posterior[300] > 0.95
    assert T.candidate_limits(*np.unique(np.exp(rng.normal(5, 0.7, 20_000)).astype(int), return_counts=True)) == []


@pytest.mark.parametrize(
    "text, kind",
    [
        ('{"a": 1}\n{"a": 2}', "shut"), ('{"a": 1}\n{"a": "x', "open"), ("/**\n * Words.\n */", "shut"), ("/**\n * Wor", "open"),
        ("Text\n\n```php\n$x = 1;\n```", "shut"), ("Text\n\n```php\n$x = 1;", "open"), ("See `this", "open"), ("All good.", "flat"),
        ("method: a\nsource:\nfunction a()\n{\n    b();\n}", "shut"), ("method: a\nsource:\nfunction a()\n{\n    b(", "open"), ("class_header: A\nsource:\nclass A extends B\n{\n    protected int $x;", "flat"),
    ],
)
def test_structure(text, kind):
    assert T.structure(text) == kind


def test_markers_are_told_from_words():
    assert T.strip_end("some wor\n// [truncated]  ") == ("some wor", "marker")
    assert T.strip_end("some wor [...]") == ("some wor", "marker")
    assert T.strip_end("some wor...\n") == ("some wor", "ellipsis")
    assert T.strip_end("end�") == ("end", "broken")
    assert T.strip_end("end. ") == ("end.", "plain")


@pytest.mark.parametrize("text", ["The end", "a\nThe end of it.", "x\n\n- drop FooBar v1.2.3 at /a/b", "One\nTwo Three", "word " * 80 + "end", "A b c d e f g h i j k l m n o", "\n", "Äpfel\n漢字 end"])
def test_one_ending_agrees_with_the_counts(text):
    known = T.vocabulary()
    ids = np.array([known[t] for t in T.FIND(text)])
    known.learn()
    own, general, whole = (int(b[-1]) for b in T.contexts(np.full(len(ids), T._source_hash("s"), np.uint64), known, ids))
    last, where = T.ending("s", text)
    assert not last or (where == (own, general, whole) and last[-1] is known.tokens[ids[-1]])


def test_limits_of_long_texts_are_exact(spark):
    rng = np.random.default_rng(4)
    n = np.minimum(np.exp(rng.normal(11.6, 0.3, 4_000)).astype(int), 131_072)
    docs = spark.createDataFrame([("a", int(x), int(x) + 7) for x in n], "source string, n_char int, n_byte int")
    rows = T.length_limits(docs).collect()
    assert {(r["unit"], r["length"]): r["documents"] for r in rows} == {("char", 131_072): int((n == 131_072).sum()), ("byte", 131_079): int((n == 131_072).sum())}
    assert all(r["posterior"] > 0.9 and r["mu"] == pytest.approx(11.6, abs=0.05) for r in rows)


def test_keys_of_many_words_do_not_collide():
    words = [f"{a}{b}{c}{d}" for a in "bcdfghjklm" for b in "aeiou" for c in "npqrstvwxz" for d in ("ab", "ec", "id", "of", "ug")] + [chr(0x4E00 + i) + chr(0x4E00 + j) for i in range(200) for j in range(200)]
    assert len({T.Token("word", w).pieces[0] for w in words}) == len(set(words))
    halves = {(h >> 32) ^ (h & 0xFFFFFFFF) for h in map(T.text_hash, ("abcd", "efgh", "ijkl"))}
    assert len(halves) == 3  # the two halves of a hash are independent


def test_counts_are_those_of_the_texts(spark):
    rows = [(i, "news", "off", i, t) for i, t in enumerate(["Alpha beta.\nGamma beta gamma", "Alpha delta.\nGamma"])]
    texts = spark.createDataFrame(rows, "doc_id bigint, source string, limit_key string, h bigint, text string")
    sketches = texts.mapInPandas(T._sketches, "doc_id bigint, source string, limit_key string, h bigint, real_word string, real_keys array<bigint>, made_word string, made_keys array<bigint>, inside int")
    counts = {r["key"]: (r["total"], r["texts"]) for r in T.corpus_counts(sketches, texts).collect()}
    assert [counts[T.Token("word", w).last_piece] for w in ("alpha", "beta", "gamma", "delta")] == [(2, 0), (2, 0), (1, 2), (1, 0)]


def test_cuts_at_the_same_place_prove_nothing(spark):
    rng, names = random.Random(6), [a + b for a in ("Amber", "Batch", "Cargo", "Daily", "Early") for b in ("Kiln", "Lease", "Mooring", "Orchard", "Pallet")]
    whole = ["move every row of {} behind the new guard because {} relied on {}".format(*rng.sample(names, 3)) for _ in range(2_000)]
    cut = [t[: t.index(" new guard") + n] for t in whole[:12] for n in (2, 8)]  # within a word
    texts = spark.createDataFrame([(i, "notes", "off", t) for i, t in enumerate(whole + cut)], "doc_id bigint, source string, limit_key string, text string")
    ending = {r["doc_id"]: r["real"] for r in T.describe(texts.selectExpr("doc_id", "source", "limit_key", "xxhash64(text) AS h", "text")).collect()}
    assert {ending[i] for i in range(2_000)} == {"flat|word|known|line|plain"}
    assert {ending[i] for i in range(2_000, 2_024)} == {"flat|word|odd|low|plain"}
