"""Where stored tables go, and that they go away."""

from pathlib import Path

import pytest

from zonewright.functions import storage


class Elsewhere:
    """A session of a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master, applicationId = "spark://head:7077", "app-1"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch_root(Elsewhere)


def test_stored_tables_are_read_back_and_removed(spark):
    kept = dict(storage._stored)
    storage._stored.clear()
    try:
        df = storage.materialize(spark.range(5), "five")
        path = Path(storage._stored[spark.sparkContext.applicationId][0].removeprefix("file://"))
        assert df.count() == 5 and path.exists()
        storage.discard(spark)
        assert not path.exists() and not storage._stored
        storage.discard(spark)  # nothing is left to remove
    finally:
        storage._stored.update(kept)
