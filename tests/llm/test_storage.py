import re
from pathlib import Path

from palimpsest.llm import storage


def _resident_mb(pid):
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


def test_the_driver_gives_back_what_it_freed(spark):
    """160 MB of the JVM's memory outside the heap, freed but for a block in 16, are the system's after the next table."""
    for _ in range(3):  # what the first tables load and compile comes before
        storage.materialize(spark.range(1), "trimmed")
    jvm = spark.sparkContext._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, size = field.get(None), 64 << 10
    blocks = [unsafe.allocateMemory(size) for _ in range(2560)]
    for block in blocks:
        unsafe.setMemory(block, size, 1)
    for block in [b for i, b in enumerate(blocks) if i % 16]:
        unsafe.freeMemory(block)
    before = _resident_mb(pid)
    storage.materialize(spark.range(1), "trimmed")
    after = _resident_mb(pid)
    for block in blocks[::16]:
        unsafe.freeMemory(block)
    assert before - after > 75, (before, after)


def test_a_driver_that_cannot_give_back(spark, monkeypatch):
    """A JVM without that command goes on without it."""
    real = spark.sparkContext._jvm

    class Without:
        javax = type("", (), {"management": type("", (), {"ObjectName": staticmethod(lambda _: real.javax.management.ObjectName("none:type=None"))})})
        java = real.java

    monkeypatch.setattr(spark.sparkContext, "_jvm", Without)
    storage.give_back_driver(spark)
