from types import SimpleNamespace

import pytest

from stormlake.session import work_path


def session(master, **conf):
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_work_files_go_to_the_named_folder_on_any_master():
    for master in ("local[2]", "spark://host:7077"):
        one, other = (work_path(session(master, **{"spark.checkpoint.dir": "file:/shared/"}), "x") for _ in range(2))
        assert one.startswith("file:/shared/stormlake/x-") and one != other


def test_only_a_local_master_may_go_without_a_folder():
    local = session("local[2]", **{"spark.sql.warehouse.dir": "/warehouse"})
    assert work_path(local, "x").startswith("/warehouse/_work/stormlake/x-")
    with pytest.raises(ValueError):
        work_path(session("spark://host:7077"), "x")
