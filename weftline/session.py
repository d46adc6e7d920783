"""Session settings shared by tests, the bench and ad-hoc runs."""

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine; on a cluster the submitter's settings hold instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("weftline")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


#: Rows of a table that a task is dealt at most on average: what it holds doesn't grow with the table.
ROWS_A_TASK = 1 << 18


def tasks(rows: DataFrame) -> int:
    """How many tasks a table's rows are dealt to: the session's shuffle partitions, more if a task had over ROWS_A_TASK. Files' footers tell the count."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_A_TASK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
