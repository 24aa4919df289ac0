import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weftline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, memory="8g", shuffle_partitions=3)


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def clean(spark, sf):
    from workload import fixtures
    from weftline.session import materialise

    return materialise(fixtures.paf(spark, sf), "test-paf")


@pytest.fixture(scope="session")
def noisy(clean):
    from workload import fixtures
    from weftline.session import materialise

    return materialise(fixtures.paf_noisy(clean), "test-noisy")


def whole_sequences(pieces, keys):
    """One string per contig, for contigs that fit a single value."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "block", "seq")))
    return pieces.groupBy(*keys).agg(F.concat_ws("", F.transform(ordered, lambda p: p["seq"])).alias("seq"))
