"""What the session helpers do to the driver."""

from rolloom.session import release


def test_release_leaves_little_of_the_heap_free_and_keeps_settings(spark):
    jvm = spark.sparkContext._jvm
    bean = jvm.java.lang.management.ManagementFactory.getPlatformMXBean(jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    settings = lambda: [bean.getVMOption(x).getValue() for x in ("MinHeapFreeRatio", "MaxHeapFreeRatio")]
    before, heap = settings(), jvm.java.lang.Runtime.getRuntime()
    spark.range(100000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    release(spark)
    assert settings() == before
    assert heap.freeMemory() < 0.5 * heap.totalMemory()
