"""Whole jobs that the first round of advice found cut."""

from tallymart.llm import html_extract, toxicity


def test_misspelling_within_a_stem_is_matched():
    m = toxicity.Matcher(toxicity.Model({"idiot": 5.0, "worthless": 5.0}, {"idio": 4.0, "worth": 4.0}, frozenset(), None))
    assert all(m.weight(w) > 0 for w in ("idot", "1diot", "iidiot", "wrothless", "w0rthles", "idiotic"))
    assert m.weight("house") == m.weight("idea") == 0


def test_copies_of_a_page_do_not_make_its_article_a_template(spark):
    def page(k):
        body = " ".join(f"sentence {k} {j} of the story" for j in range(40))
        return f"<html><body><div class='box'>Every page says so</div><article><h1>Heading {k}</h1><p>{body}</p><ul><li>point {k}</li></ul></article></body></html>"

    def texts(pages):
        rows = [(i, f"https://h.example/{i}", page(k)) for i, k in enumerate(pages)]
        got = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
        return [r["text"] for r in got.orderBy("page_id").collect()]

    for pages in ([0] * 12, [0] * 40 + list(range(1, 8)), [0] * 40 + list(range(1, 10))):
        assert all(f"Heading {k} " in t and f"point {k}" in t and "Every page" not in t for k, t in zip(pages, texts(pages), strict=True))
