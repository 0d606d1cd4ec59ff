import os
import time

import pytest
from test_index_store import SCHEMA, rows

from lodeseam.operators.steps import shared_folder
from lodeseam.service import Service
from lodeseam.sources.index_store import IndexStore

QUESTION = {"question": "w1 w2 w3 资产 12.5%", "domain": "d0", "doc_ids": "doc1,doc2", "top_k": 5}


def left(spark):
    at = f"{shared_folder(spark).removeprefix('file:')}/lodeseam-steps-{spark.sparkContext.applicationId}"
    return sorted(os.listdir(at)) if os.path.isdir(at) else []


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(4, 80), SCHEMA).cache()


def test_a_call_leaves_no_folder_and_a_store_gives_the_same(spark, table, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.append(table.where("doc_id < 'doc2'"))
    store.append(table.where("doc_id >= 'doc2'"))
    show = lambda found: [(r["doc_id"], r["chunk_id"], round(r["score"], 6), r["text"]) for r in found]
    with Service(table) as plain, Service.of_store(store) as stored:
        plain.search(**QUESTION)
        before = left(spark)
        began = time.time()
        want = plain.search(**QUESTION)
        print("warm search", round(time.time() - began, 2))
        assert want and show(stored.search(**QUESTION)) == show(want)
        assert stored.handle("GET", "/health", {})[1]["domains"] == ["d0", "d1"]
        assert left(spark) == before
