import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.path.join(ROOT, "tests", "data")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from veil.session import local_session

    s = local_session(master="local[4]", app="veil-tests")
    yield s


@pytest.fixture(scope="session")
def staff(spark):
    from veil import Metadata, read_csv

    md = Metadata(
        column_types={"badge": "numeric", "years": "numeric", "office": "numeric", "team": "categorical"},
        identifiers=["badge"], quasi_identifiers=["years", "office"], sensitive_attributes=["team"],
    )
    return read_csv(spark, os.path.join(DATA, "staff.csv"), md), md


@pytest.fixture()
def scratch(spark):
    from veil.session import scratch_path

    return lambda name: scratch_path(spark, name)
