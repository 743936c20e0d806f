"""Ids, repeated rows and clashing names: what every operator does with rows, whatever their texts."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import PASSAGE, prose
from tidewatch.llm import decontaminate, html_extract, langid, lz_fingerprint, minhash_dedup, mixing, pii, secrets, suffix_dedup, toxicity

BIG = (1 << 53) + 1


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(BIG, prose(1, 60) + " " + PASSAGE, "en", "s"), (None, prose(2, 60) + " " + PASSAGE, "fr", "s"), (3, None, "en", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def toxic(d):
    labels = d.sparkSession.createDataFrame([(BIG, 1), (3, 0)], "doc_id long, toxic int")
    return toxicity.score(d, toxicity.fit(d, labels))


@pytest.mark.parametrize("run", [
    mixing.mix_sizes, lambda d: langid.identify(d, langid.fit(d)), lz_fingerprint.compare_with_next, suffix_dedup.deduplicate,
    lambda d: html_extract.extract_pages(d.select("doc_id", F.lit("http://h/").alias("url"), F.col("text").alias("html")), id_col="doc_id"), toxic,
    minhash_dedup.near_duplicates, lambda d: pii.pseudonymize(d, "k"), secrets.scan], ids="mix lang lz suffix html toxic near pii secrets".split())
def test_large_ids_beside_null_ones(docs, run):
    assert {r["doc_id"] for r in run(docs).collect()} == {BIG, None, 3}


def test_large_ids_of_contaminated_documents(spark, docs):
    found = decontaminate.contaminated(docs, spark.createDataFrame([(BIG + 2, PASSAGE), (None, PASSAGE)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(BIG, BIG + 2), (BIG, None), (None, BIG + 2), (None, None)}


def test_many_repeated_rows_of_a_long_text(spark):
    text = prose(5, 400)
    d = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")).unionByName(spark.createDataFrame([(5000, "x" * 50 + text[100:400] + "y" * 50), (5000, prose(6, 90))], "doc_id long, text string"))
    begun = time.monotonic()
    rows = suffix_dedup.deduplicate(d).collect()
    assert time.monotonic() - begun < 60
    n = len(text)
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(r["n_removed"] for r in rows) == sorted([0, 300] + [n] * 1000) and sum(r["kept_sha256"] == empty and r["n_spans"] == 1 for r in rows) == 1000


def pages(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_copies_of_a_page_are_no_template(spark):
    body = "<article><h1>Title</h1><div><p>Whole body text.</p></div></article>"
    bare = "<div><h2>Head</h2><p>Some text of its own.</p></div>"
    got = pages(spark, [(1, "http://h/a", body)] * 4 + [(i, f"http://h/{i}", body) for i in range(2, 6)] + [(10 + i, f"http://g/{i}", bare) for i in range(4)])
    assert set(got.values()) == {"Title\nWhole body text.", "Head\nSome text of its own."}


def test_template_of_a_host_goes(spark):
    """Against counting by hand: only blocks on four pages of the host go, and only there."""
    menu = "<div><p>Home of all news</p></div>"
    rows = [(i, f"http://{h}/{i}", f"{menu}<div><p>Story number {i} of {h}.</p></div>") for h, n in (("a", 6), ("b", 3)) for i in [100 * (h == "b") + k for k in range(n)]]
    got = pages(spark, rows)
    assert got == {i: f"Story number {i} of a." if i < 100 else f"Home of all news\nStory number {i} of b." for i, _, _ in rows}


def test_template_is_counted_on_pages_with_an_article(spark):
    menu = "<ul><li>Home of all news</ul>"
    rows = [(i, f"http://a/{i}", f"<div>{menu}</div><article><h1>Title {i}</h1><p>Story {i}.</p></article>") for i in range(4)]
    rows += [(10 + i, f"http://b/{i}", f"<nav><div>{menu}</div></nav><article><p>Story {i}.</p></article>") for i in range(4)]
    rows += [(x, f"http://{h}/x", f"<div>{menu}</div><p>No article here.</p>") for x, h in ((20, "a"), (21, "b"))]
    got = pages(spark, rows)
    assert got == {**{i: f"Title {i}\nStory {i}." for i in range(4)}, **{10 + i: f"Story {i}." for i in range(4)}, 20: "No article here.", 21: "No article here."}


def test_template_within_an_article_goes(spark):
    """A box on most articles of the host goes; on few, in headings, or as copies and versions of an article, text stays."""
    box, few, head = "<div><p>Get our letter each week.</p></div>", "<div><p>In four of the ten.</p></div>", "<div><h2>Steps</h2></div>"
    same, short = "<div><p>The whole body of one article.</p></div>", "<div><p>Taken down.</p></div>"
    rows = [(i, f"http://a/{i}", f"<main>{box}<article><h1>Title {i}</h1>{few if i < 4 else ''}{head}<p>Story {i} of the ten.</p>{box}</article></main>") for i in range(10)]
    rows += [(20 + i, f"http://b/{i}", f"<div>Page {i}</div><article><h1>Title</h1>{same}<p>Version {i}</p></article>") for i in range(4)]
    rows += [(30 + i, f"http://c/{i}", f"<article>{same}<p>Version {i}</p></article>") for i in range(4)]
    rows += [(40 + i, f"http://d/{i}", f"<article><h1>A longer title {i}</h1>{short}</article>") for i in range(4)]
    rows += [(50 + i, f"http://e/{i}", f"<div><article><h1>Title</h1>{same}</article></div><p>Outside {i}</p>") for i in range(4)]
    want = {i: f"Title {i}\n" + "In four of the ten.\n" * (i < 4) + f"Steps\nStory {i} of the ten." for i in range(10)}
    want |= {20 + i: f"Title\nThe whole body of one article.\nVersion {i}" for i in range(4)} | {30 + i: f"The whole body of one article.\nVersion {i}" for i in range(4)}
    want |= {40 + i: f"A longer title {i}\nTaken down." for i in range(4)} | {50 + i: "Title\nThe whole body of one article." for i in range(4)}
    assert pages(spark, rows) == want


def test_attributes_are_told_from_their_values():
    page = '<article><p style="overflow: hidden">one</p><p data-id="comment 7">two</p><p data-role="banner">three</p><p title="a hidden id=comment">four</p><p hidden>five</p><p class="comment">six</p></article>'
    assert html_extract.extract(page) == "one\ntwo\nthree\nfour"


def test_country_codes_stay(spark):
    rows = [(1, "+49 30 123 4567"), (2, "+49 30 123 4568"), (3, "+1 (743) 555-3824"), (4, "(743) 555-3824"), (5, "+353 86 123 4567"), (6, "+493012345678")]
    out = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string").withColumn("_found", F.lit(1)).withColumn("_new", F.lit(2)), "k", count_col="n").collect()}
    assert all(out[i]["text"].startswith(code) and out[i]["text"] != t for (i, t), code in zip(rows, ("+49 ", "+49 ", "+1 ", "(", "+353 ", "+49"), strict=True))
    assert out[3]["text"][3:] == out[4]["text"] and (out[1]["_found"], out[1]["_new"], out[1]["n"]) == (1, 2, 1)


def test_items_of_few_words(spark):
    d = spark.createDataFrame([(1, "so the cat sat down on it"), (2, "the cat, SAT down!"), (3, "the cat down sat"), (4, "cat")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The cat sat down"), (2, "dog")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["first_word"], r["n_words"]) for r in decontaminate.contaminated(d, items).collect()}
    assert got == {(1, 1, 1, 4), (2, 1, 0, 4)}
    assert {r["doc_id"] for r in decontaminate.clean(d, items).collect()} == {3, 4}


def test_columns_called_copy(spark):
    d = spark.createDataFrame([(1, "a b", "s", 5, 6)], "doc_id long, text string, source string, copy int, copy_before int")
    r = mixing.mix(d).first()
    assert (r["copy"], r["copy_before"], r["copy_before_"]) == (1, 6, 5)


def test_letters_have_their_own_vectors():
    a, b = (langid.trigrams(c * 3) for c in "бл")
    assert not set(a.tolist()) & set(b.tolist()) and len({tuple(langid.space().make(x)[1]) for x in (a, b)}) == 2
