"""Recall of the index search against the exact one."""

import pytest

from simforge.operators import ivf, vector_search as vs
from simforge.plans import vector_queries as vq


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_index_search_finds_nine_of_ten_neighbours(spark, folder):
    e = vq.embeddings(spark, folder)
    exact = vs.shown(vs.knn_join(e, e, k=10))
    recall = ivf.recall_at_k(vq.v5_ivf_search(spark, folder), exact).first()[0]
    print(folder, recall)
    assert recall >= 0.9
