"""Pairs of days whose episodes start at once, dealt over many partitions."""

from datetime import datetime, timedelta

import duckdb
import pytest

from daymosaic.plans.queries import QUERIES
from daymosaic.plans.sql import SQL

from .conftest import same_rows

KINDS = ["view", "click", "purchase", "signup", "other"]


@pytest.mark.parametrize("name", ["pairwise_default", "pairwise_hamming", "pairwise_chamfer"])
def test_ties_follow_the_order_of_the_sql(spark, tmp_path, name):
    # Every user's first episode starts at 0, so a day is a row of ties.
    rows = [(user, 100 * user + day, datetime(2024, 1, day) + timedelta(minutes=60 * (user % 3)), KINDS[(user * user + day) % 5]) for user in range(40) for day in (1, 2, 3, 4)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would meet in one partition
    try:
        assert same_rows(QUERIES[name](spark, str(tmp_path)), con, SQL[name]) == 6
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
