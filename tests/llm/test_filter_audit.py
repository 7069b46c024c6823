"""The audit of filters against a plain version that applies every order in turn, and against SQL."""

import random
import re
from itertools import permutations

import duckdb
import pytest

pytest.importorskip("tracelake.llm")

from tracelake.llm import filter_audit  # noqa: E402

SMALL = "/root/testdata/sf0.001"
COLUMNS = "part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley".split(", ")
SCHEMA = "doc_id long, text string, lang string, mask int, part string, n int, first string"
BIG = 2**60


def odd_rows():
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.sample(words, 150)), " ".join(rng.choices(words[:80], k=150)), "A B C " * 40, "few words # here", " ".join(words[:99]), " ".join(words[:100]) + "\n", "\x0b\x0c\t", "", None]
    texts += ["Á" * 5 + "ABC", "x" * 90 + "A" * 10, "x" * 89 + "A" * 11, "a|b", " ".join(words * 60), "tail and\u0085more " * 50]
    rows = [(k, rng.choice(texts), rng.choice(["en", "en", "fr", None, ""])) for k in range(300)]
    rows += [(BIG + k, texts[0], "de") for k in range(3)] + [(None, texts[0], "de"), (None, texts[0], "de"), (None, "only without an id #", "de")]
    rows += [rows[5], rows[5], (7, "another text of the same id", "en"), (400, "another text of the same id", "en"), (2, "another text of the same id", "xx")]
    return rows


LABELS = [(k, k % 3 and 1, int(k % 4 == 0)) for k in range(0, 300, 2)] + [(10, 1, None), (10, None, 1), (None, 1, 1), (BIG + 1, 1, 1), (9999, 1, 1)]


def fails(rows):
    out = []
    by = {}
    for i, text, _ in rows:
        if i is not None:
            by.setdefault(text or "", []).append(i)
    for i, text, _ in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append(
            {
                "A": len(w) < 100,
                "B": 100 * len(set(w)) < 80 * len(w),
                "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
                "D": bool(re.search("[#$%&*|]", text)),
                "E": i is not None and i > min(by[text]),
            }
        )
    return out


def plain(rows, labels):
    told, out = fails(rows), []
    good, toxic = ({i for i, *l in labels if i is not None and l[k] == 1} for k in (0, 1))
    for part in sorted({lang or "" for _, _, lang in rows}):
        own = [(i, f) for (i, _, lang), f in zip(rows, told, strict=True) if (lang or "") == part]
        lines, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                sums[name] += len(gone)
                failing = sum(f[name] for _, f in own)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in own)
                lines.append((name, part, "".join(order), step, len(left), len(gone), failing - len(gone) - sum(f[name] for _, f in left), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)))
        out += [(*line[1:], sums[line[0]]) for line in lines]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2, "q") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("setup", ["usual", "saturated"])
def test_every_order_as_applied_in_turn(spark, labels, setup, monkeypatch):
    if setup == "saturated":  # no text is cleared by the sketches any more
        monkeypatch.setattr(filter_audit, "HASHES", 1)
        monkeypatch.setattr(filter_audit, "places", lambda h, bits: (h[:, None] & 1).astype("int64"))
    got = filter_audit.audited(frame(spark, odd_rows()), labels)
    assert got.columns == COLUMNS
    assert sorted(tuple(r) for r in got.collect()) == plain(odd_rows(), LABELS)


def test_unique_texts_are_cleared_before_the_shuffle(spark):
    rows = [(k, f"text {k}", "en") for k in range(20_000)] + [(30_000 + k, f"text {k}", "en") for k in range(50)]
    docs = frame(spark, rows)
    flags = filter_audit.flagged(docs)
    told = filter_audit.with_copies(docs, flags).where("mask >= 16")
    assert sorted(r.doc_id for r in told.collect()) == list(range(30_000, 30_050))
    bits = filter_audit.sized(20_050)
    again = filter_audit.merged(filter_audit.sketches(flags, bits)).collect()
    at = sum(bin(int.from_bytes(r.bits, "little")).count("1") for r in again)
    assert 50 <= at < 5_000  # of 40,000 counters that are set


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "en")] * 3])
def test_few_rows(spark, labels, rows):
    for marks in (labels, labels.where("false")):
        got = filter_audit.audited(frame(spark, rows), marks)
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, LABELS if marks is labels else [])


def test_as_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    got, want = filter_audit.query(spark, SMALL).toPandas(), con.execute(filter_audit.SQL).df()
    assert list(got.columns) == list(want.columns) == COLUMNS
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
