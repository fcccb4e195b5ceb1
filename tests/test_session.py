"""The session's helpers when several threads use them at a time."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier
from types import SimpleNamespace

from noveltide import session


def test_threads_ship_the_package_once():
    """Spark refuses a second file of one name, so cells of an experiment that began at a time failed."""
    shipped, start = [], Barrier(4)

    def add(path):
        time.sleep(0.1)
        shipped.append(path)

    spark = SimpleNamespace(sparkContext=SimpleNamespace(addPyFile=add))

    def run(_):
        start.wait()
        session.ship(spark)
        return len(shipped)

    with ThreadPoolExecutor(4) as pool:
        seen = list(pool.map(run, range(4)))
    assert seen == [1] * 4
