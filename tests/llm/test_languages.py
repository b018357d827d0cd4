"""Every language has a reference, or its texts are judged by the base rules alone."""
from skepsis.llm import quality

from .conftest import prose


def other(text, by):
    """The same text in words of another language."""
    return text.lower().translate(str.maketrans("aeioubcdf", by))


def test_languages_beyond_the_drivers_and_small_ones(spark):
    kinds = {"aa": "aeioubcdf", "bb": "uoieakvwx", None: "yzqjhkvwx", "small": "éèíôúßçðþ"}
    rows = [(1000 * k + i, other(prose(31 * k + i, 150), by), lang) for k, (lang, by) in enumerate(kinds.items()) for i in range(2 if lang == "small" else 30 - 5 * k)]
    rows.append((9000, " ".join(f"ZQ{j * 7919 % 10007} |" for j in range(200)), "bb"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    refs = quality.references(docs, most=1)
    assert [r.language for r in refs] == ["aa"] and {r["lang"] for r in refs.rest.collect()} == {"bb", None}
    few = {r["doc_id"]: r for r in quality.judge(docs, refs).collect()}
    assert len(few) == len(rows) and not few[9000]["kept"]
    assert all(r["kept"] for r in few.values() if r["doc_id"] != 9000)
    assert all(r["word_distance"] is None and r["class_distance"] is None and r["nearest"] is None for r in few.values() if r["lang"] == "small")
    many = {r["doc_id"]: r for r in quality.judge(docs, quality.references(docs)).collect()}
    assert all(few[i]["kept"] == many[i]["kept"] and few[i]["nearest"] == many[i]["nearest"] for i in few)
