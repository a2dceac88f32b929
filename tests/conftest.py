import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from saleslens.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def con(sf_dir):
    from compare import connect

    return connect(sf_dir)


def fact_row(**values):
    """A fact row with defaults; specifications are '' unless given."""
    from saleslens.constants import SPEC_COLUMNS

    row = {"brand": "HINO", "segment": "Truck", "model": "M1", "month": "jan",
           "sales_type": "wholesales", "sales": 1, "year": 2024, "is_summary": False,
           "row_index": 1, "vr_id": "VR000001", **{c: "" for c in SPEC_COLUMNS}}
    row.update(values)
    return row


@pytest.fixture(scope="session")
def make_fact(spark):
    from saleslens.schema import FACT

    def make(*rows):
        full = [fact_row(**r) for r in rows]
        return spark.createDataFrame([tuple(r[n] for n in FACT.fieldNames()) for r in full], FACT)

    return make


@pytest.fixture(scope="session")
def make_sheet(spark):
    from saleslens.schema import SHEET_ROWS

    def make(rows, path="2024/HINO.xlsx"):
        return spark.createDataFrame([(path, i, cells) for i, cells in rows], SHEET_ROWS)

    return make


def sheet_line(vr_id, months=None, width=73, **named):
    """A sheet row: an id, named columns, and {(sales_type, month): text}."""
    from saleslens.constants import MONTHS, SALES_BLOCKS, SHEET_POSITIONS

    cells = [None] * width
    cells[0] = vr_id
    for name, value in named.items():
        cells[SHEET_POSITIONS[name]] = value
    for (sales_type, month), value in (months or {}).items():
        cells[SALES_BLOCKS[sales_type][2] + MONTHS.index(month)] = value
    return cells
