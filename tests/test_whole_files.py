"""Files with the blocks of every kind are ingested, and the stored tables and what follows from them hold the rows that SQL states."""

import pytest

from fixtures import cases_core, cases_fleet  # noqa: F401
from fixtures.cases import CASES, plain
from fixtures.render import fleet, whole_files
from fleetlens.operators import views
from fleetlens.plans.fleet import EXTRACTIONS, PER_RUN, Fleet
from fleetlens.sources import snapshots as src
from fleetlens.sources.warehouse import read_table
from fleetlens.streaming import ingest
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = [n for n in [*EXTRACTIONS, *PER_RUN, *[v.__name__ for v in views.VIEWS]] if n in CASES and CASES[n].sql]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module")
def ingested(spark, tmp_path_factory):
    root, files = str(tmp_path_factory.mktemp("whole") / "store"), whole_files(spark, SF)
    ingest.ingest_batch(spark, files, root)
    opened = Fleet(spark, src.snapshots(files), fleet(spark, SF)("host_inventory"))
    for name in ["run_registry", "run_commands", *EXTRACTIONS, *PER_RUN]:
        opened.put(name, read_table(spark, root, name, like=opened(name) if name in EXTRACTIONS else None))
    return opened


def test_files_hold_every_kind(ingested):
    tags = {r["command_tag"] for r in ingested("run_commands").select("command_tag").distinct().collect()}
    assert {t for _, needed in EXTRACTIONS.values() for t in needed} - tags <= {"ls_etc_init", "ls_etc_rc_d"}  # the tables give these folders no files
    assert len(tags) > 70


@pytest.mark.parametrize("name", NAMES)
def test_table(ingested, con, name):
    want = [c[0] for c in con.execute(CASES[name].sql).description]
    df = plain(ingested(name))
    ok, message = compare(df.select(*[c for c in df.columns if c in want]), con, CASES[name].sql)
    assert ok, message
