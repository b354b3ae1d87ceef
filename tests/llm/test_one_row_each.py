"""Near copies leave one row a group, whatever their ids."""

import pytest

from stepweave.llm import common, simhash

SAME, OTHER, LOST = "one two three four five six seven", "the quick brown fox jumps over a lazy dog", "lost words are found here again"


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_repeated_and_null_ids_leave_one_row_a_group(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "GONE", most)
    rows = [(1, SAME), (1, SAME), (2, SAME), (None, SAME), (1, OTHER), (0, OTHER), (None, LOST), (None, LOST)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row_key int")
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text, r.doc_id) for r in kept.collect()) == sorted([(SAME, 1), (OTHER, 0), (LOST, None)])


def test_written_tables_can_be_removed(spark):
    import os

    common._made.clear()
    kept = common.written(spark.range(5), "removed")
    assert kept.count() == 5
    path = common._made[0].removeprefix("file://")
    assert os.path.isdir(path)
    assert common.remove_written(spark) == 1 and not os.path.isdir(path) and common.remove_written(spark) == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
