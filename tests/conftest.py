import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers find the package wherever pytest was started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from gritsieve.functions.cells import ROW_ID  # noqa: E402
from gritsieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "gritsieve-tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def frame(spark):
    """Build a DataFrame with row ids from columns of equal length."""

    def build(columns: dict[str, tuple[str, list]], partitions: int = 3, row_id: bool = True):
        ddl = ", ".join(f"`{name}` {kind}" for name, (kind, _) in columns.items())
        rows = list(zip(*[values for _, values in columns.values()]))
        if row_id:
            ddl, rows = f"{ROW_ID} bigint, {ddl}", [(i, *r) for i, r in enumerate(rows)]
        return spark.createDataFrame(rows, ddl).repartition(partitions)

    return build
