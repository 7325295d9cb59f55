"""The search over documents of all languages against plain counts."""

import math
import re

from strandql import queries as catalogue

SF = "/root/testdata/sf0.01"


def test_text_search_over_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    tally = {r["doc_id"]: [len(re.findall(rf"\b{w}\b", (r["text"] or "").lower())) for w in ("the", "license")] for r in docs}
    idf = [1 + math.log(len(docs) / sum(c[k] > 0 for c in tally.values())) for k in range(2)]
    want = {i: sum((1 + math.log(n)) * f for n, f in zip(c, idf)) for i, c in tally.items() if all(c)}
    found = {r["doc_id"]: r["score"] for r in catalogue.QUERIES["text_tfidf"](spark, SF).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - s) < 2e-6 for i, s in want.items())
    assert {r["lang"] for r in docs if r["doc_id"] in found} - {"en"}
