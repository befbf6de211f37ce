"""Texts over the slice bound, null and repeated ids, and columns named as the operators' own, through every operator."""

import hashlib
import random

import pytest
from test_operators import WORD, brute_decontaminate, brute_jaccard, brute_lines, brute_substrings

from tracklake.llm import classifier, decontaminate, jaccard, language_model, licenses, line_templates, mixing, quality_rules, secrets, substrings

CLASHING = "id long, n int, key string, sign string, component_id int, n_words string, kept int, spans int, n_removed int, copies int, score string, line_count int, mix_copies int, row int, label_mean int"
KEY = "Zx81kQmP0vLr72TnWcYb93HdUeSg46Jf"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(6)
    vocab = ["".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9))) for _ in range(5000)]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = line(60)
    long = "\n".join([line(40) for _ in range(4200)] + [passage, f"login with {KEY} now", licenses.TEMPLATES["gpl-3.0-header"], line(30)])
    assert len(long) > 1 << 20
    return [(1, f"{line(50)}\n{passage}"), (2, long), (3, long.replace(KEY, "another")), (4, None), (4, ""), (None, line(40)), (5, line(300)), (5, line(300))]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, ["en", "fr", None][k % 3], ["a", "b"][k % 2], *[None] * 15) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {CLASHING}").repartition(2).cache()


def by_id(df, *cols):
    return sorted(((r.doc_id if r.doc_id is not None else -1, *(r[c] for c in cols)) for r in df.collect()), key=repr)


def want(texts, f):
    return sorted(((-1 if i is None else i, *f(i, t or "")) for i, t in texts), key=repr)


def test_counts(table, texts):
    n = lambda i, t: (len(WORD.findall(t)),)
    assert by_id(quality_rules.judge(table), "n_words") == want(texts, n)
    mixed = mixing.mix(table)
    assert by_id(mixed, "mix_size") == want(texts, n) and set(table.columns) <= set(mixed.columns)
    assert by_id(language_model.score(table, table.where("doc_id = 2").select("doc_id")), "n_words") == want(texts, n)
    assert len(by_id(classifier.score(table, classifier.train(table, table.selectExpr("doc_id", "1 as quality"), "quality")), "score")) == len(texts)
    assert quality_rules.filter_documents(table).columns == table.columns


def test_searches(table, texts, spark):
    item = " ".join(texts[1][1].split()[-100:-70])
    bench = spark.createDataFrame([("q", item, 1), (None, "x", 2)], "item_id string, text string, id int")
    hits = brute_decontaminate([(k, t) for k, (_, t) in enumerate(texts)], [("q", item), ("", "x")])
    for block in (16_000_000, 5):  # in one block, and in a block for each item
        found = decontaminate.digest(decontaminate.find_matches(table, bench, block_chars=block))
        assert by_id(found, "n_words", "n_hit") == sorted(((-1 if i is None else i, *hits[k][:2]) for k, (i, _) in enumerate(texts)), key=repr)
    got = by_id(secrets.scan(table), "spans")
    spot = texts[1][1].index(KEY)
    assert [x for x in got if x[1]] == [(2, f"novel:{spot}:{spot + len(KEY)}")]
    assert sorted(r.doc_id for r in licenses.scan(table).where("n_copies > 0").collect()) == [2, 3]


def test_copies(table, texts):
    got = by_id(jaccard.join(table), "component_id")
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, 1), (2, 2), (3, 2)]
    plain = [(i, t) for i, t in texts if i in (1, 2, 3)]
    out = line_templates.strip(table)
    assert out.columns == table.columns and by_id(out.where("doc_id < 4"), "text") == sorted(brute_lines(plain, 2, 10).items())
    assert brute_jaccard([x for x in texts if x[0] == 1]) and brute_substrings([x for x in texts if x[0] == 1])
    # the second long text goes but for what the first doesn't have
    cut = {(r.doc_id, r.n_bytes): r for r in substrings.dedup(table).collect() if r.doc_id}
    size = {i: len((t or "").encode()) for i, t in texts if i in (1, 2, 3)}
    assert cut[2, size[2]].n_removed >= len(texts[0][1].split("\n")[1]) and 0 < size[3] - cut[3, size[3]].n_removed < 400
    assert cut[1, size[1]].kept_sha256 == hashlib.sha256(texts[0][1].encode()).hexdigest()
