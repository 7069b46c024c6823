"""The whole job where an operator once did less."""

import random

import pytest

pytest.importorskip("tracelake.llm")

from tracelake.llm import html_text, license_scan, near_dedup  # noqa: E402


@pytest.mark.parametrize(("percent", "small", "large"), [(80, 180, 225), (85, 200, 235), (85, 130, 152), (80, 224, 280)])
def test_nested_sets_at_the_threshold_are_not_estimated_away(spark, percent, small, large):
    rng = random.Random(small)
    rows = []
    for k in range(100):
        words = [f"v{rng.getrandbits(60):x}" for _ in range(large + near_dedup.WORDS - 1)]
        rows += [(2 * k, " ".join(words[: small + near_dedup.WORDS - 1])), (2 * k + 1, " ".join(words))]
    sets = near_dedup.sketches(spark.createDataFrame(rows, "doc_id long, text string"))
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(100)], "a long, b long")
    assert 100 * small >= percent * large
    assert near_dedup.estimated(pairs, sets.withColumnRenamed("doc_id", "rep"), percent).count() == 100


def test_licences_wrapped_over_lines_are_found(spark):
    rows, want = [], {}
    for label, texts in license_scan.TEMPLATES.items():
        for text in texts:
            for width in (5, 12):
                w = text.split()
                lines = ["# " + " ".join(w[k : k + width]) for k in range(0, len(w), width)]
                for before in (0, 20, 31, 45):  # at different places of the chunks
                    rows.append((len(rows), "\n".join([" ".join(f"x{k}" for k in range(before)), *lines, "import os"])))
                    want[len(rows) - 1] = label
    # the words of a template, but far apart
    rows.append((9999, "\n".join(f"{w} and a few more other things here" for w in license_scan.TEMPLATES["bsd"][0].split())))
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[k].labels.split(",") and got[k].score == 1 for k, label in want.items())
    assert not got[9999].by_block and got[9999].score == 0


def test_recurring_texts_choose_the_root_and_stay_in_it(spark):
    page = "<body><div class=top><p>Welcome to our site</p></div><div class=body><h2>{0}</h2><p>{1}</p><p>{2}</p></div></body>"
    copy = page.format("Copied title", "Copied words " * 9, "Other copied words " * 9)
    pages = [(k, "https://y.example/", copy) for k in range(95)]
    pages += [(100 + k, "https://y.example/", page.format(f"Title {k}", f"Body of page {k}" * 9, f"Rest of page {k}" * 9)) for k in range(5)]
    # inside the root nothing is left out, also where a slot nearly always says the same
    pages += [(200 + k, "https://z.example/", page.format("Notes" if k else "An own title", f"Body {k}" * 9, f"Rest {k}" * 9)) for k in range(30)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[100 + k].startswith(f"Title {k}\n\nBody of page {k}") for k in range(5)) and got[0].startswith("Copied title\n\nCopied words")
    assert got[200].startswith("An own title\n\nBody 0") and all(got[200 + k].startswith(f"Notes\n\nBody {k}") for k in range(1, 30))
