"""Views derived from the given tables by SQL that runs unchanged on Spark and DuckDB.

The tables hold no bank transactions, so an order stands for one: every identifier is
computed from its keys, with valid check digits except for a known two percent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_IDS_SQL = """
SELECT o_orderkey AS k,
  concat(substr(h,1,8),'-',substr(h,9,4),'-',substr(h,13,4),'-',substr(h,17,4),'-',substr(h,21,12)) AS message_id,
  concat(split_part('Nadia,Tariq,Samina,Noor,Rabia,Shahid', ',', cast(1 + o_custkey % 6 AS int)), ' ',
         split_part('Lodhi,Mirza,Gilani,Raza,Warraich', ',', cast(1 + o_orderkey % 5 AS int))) AS account_holder,
  concat(cast(1 + o_orderkey % 7 AS string), lpad(cast(o_orderkey * 7919 % 10000 AS string), 4, '0'), '-',
         lpad(cast(o_orderkey * 104729 % 10000000 AS string), 7, '0'), '-', cast(o_orderkey % 10 AS string)) AS cnic,
  1000000000 + o_orderkey * 15485863 AS a1, 2000000000 + o_custkey * 32452843 AS a2,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('+92 3', lpad(cast(o_orderkey % 50 AS string), 2, '0'), ' ', lpad(cast(o_orderkey * 1299709 % 10000000 AS string), 7, '0'))
       WHEN o_orderkey % 3 = 1 THEN concat('03', lpad(cast(o_orderkey % 50 AS string), 2, '0'), lpad(cast(o_orderkey * 1299709 % 10000000 AS string), 7, '0'))
       ELSE concat('00923', lpad(cast(o_orderkey % 50 AS string), 2, '0'), lpad(cast(o_orderkey * 1299709 % 10000000 AS string), 7, '0')) END AS phone,
  concat('user', cast(o_custkey AS string), '@mail', cast(o_custkey % 9 AS string), '.example.com') AS email,
  o_totalprice AS amount_pkr,
  split_part('mobile_app,branch,atm,raast', ',', cast(1 + o_orderkey % 4 AS int)) AS channel,
  o_orderdate AS event_ts
FROM (SELECT o.*, md5(cast(o_orderkey AS string)) AS h FROM orders o) o
"""

TXN_SQL = f"""
SELECT k, message_id, account_holder, cnic,
       concat('PK', lpad(cast(CASE WHEN k % 50 = 0 THEN (chk1 + 1) % 100 ELSE chk1 END AS string), 2, '0'), 'RDKT', acct1) AS iban_from,
       concat('PK', lpad(cast(chk2 AS string), 2, '0'), 'LMPA', acct2) AS iban_to,
       phone, email, amount_pkr, channel, event_ts,
       CASE WHEN k % 10 < 4 THEN ''
            WHEN k % 10 = 4 THEN concat('For the savings of ', account_holder)
            WHEN k % 10 = 5 THEN concat('Deposit by ', account_holder, ', call ', phone)
            WHEN k % 10 = 6 THEN concat('Paid in by ', account_holder, ' (id card ', cnic, ') against bill #', cast(1000 + k % 9000 AS string))
            WHEN k % 10 = 7 THEN concat('Money returned; write to <', email, '>.')
            WHEN k % 10 = 8 THEN concat('Kitab Plot ', cast(1 + k % 90 AS string), 'B, PECHS Block 2, Karachi bhijwa do')
            ELSE 'School fee of the term' END AS memo
FROM (
  SELECT b.*,
    98 - (62 * 25 + (a1 % 97) * 27 + 91) % 97 AS chk1,
    98 - (74 * 25 + (a2 % 97) * 27 + 91) % 97 AS chk2,
    lpad(cast(a1 AS string), 16, '0') AS acct1, lpad(cast(a2 AS string), 16, '0') AS acct2
  FROM ({_IDS_SQL}) b
) c
"""

TXN_TEXT_FIELDS = (
    "account_holder", "cnic", "iban_from", "iban_to", "phone", "email", "channel", "memo",
)

# One raw record per transaction: JSON bytes with broker coordinates. Every tenth
# carries no personal data; one in 97 is broken, each in one of fourteen ways.
BROKEN_KINDS = 14
RAW_SQL = """
SELECT CASE WHEN k % 4 = 3 THEN 'txn.backfill' ELSE 'txn.raw' END AS topic, cast(k % 3 AS int) AS "partition", k AS "offset", k,
  CASE WHEN k % 97 <> 0 THEN concat('{"message_id": ', mid, ', "event_ts": ', ets, ', "schema_version": 1, "payload": ', payload, '}')
    WHEN b = 0 THEN NULL
    WHEN b = 1 THEN ''
    WHEN b = 2 THEN concat('{"message_id": ', mid, ', "payload')
    WHEN b = 3 THEN concat('[', mid, ']')
    WHEN b = 4 THEN concat('{"message_id": ', mid, ', "event_ts": ', ets, '}')
    WHEN b = 5 THEN concat('{"event_ts": ', ets, ', "payload": ', payload, '}')
    WHEN b = 6 THEN concat('{"message_id": ', mid, ', "payload": ', payload, '}')
    WHEN b = 7 THEN concat('{"message_id": ', cast(k AS string), ', "event_ts": ', ets, ', "payload": ', payload, '}')
    WHEN b = 8 THEN concat('{"message_id": "order-', cast(k AS string), '", "event_ts": ', ets, ', "payload": ', payload, '}')
    WHEN b = 9 THEN concat('{"message_id": ', mid, ', "event_ts": ', cast(k AS string), ', "payload": ', payload, '}')
    WHEN b = 10 THEN concat('{"message_id": ', mid, ', "event_ts": "someday", "payload": ', payload, '}')
    WHEN b = 11 THEN concat('{"message_id": ', mid, ', "event_ts": ', ets, ', "schema_version": true, "payload": ', payload, '}')
    WHEN b = 12 THEN concat('{"message_id": ', mid, ', "event_ts": ', ets, ', "payload": "', channel, '"}')
    ELSE concat('{"message_id": ', mid, ', "event_ts": ', ets, ', "payload": ', payload, '} {}') END AS body
FROM (
  SELECT t.*, (k // 97) % 14 AS b,
    CASE WHEN k % 4 = 0 THEN concat('"urn:uuid:', message_id, '"')
         WHEN k % 4 = 1 THEN concat('"{', upper(message_id), '}"')
         WHEN k % 4 = 2 THEN concat('"', replace(message_id, '-', ''), '"')
         ELSE concat('"', message_id, '"') END AS mid,
    CASE WHEN k % 2 = 0 THEN concat('"', d, 'T', lpad(cast(k % 24 AS string), 2, '0'), ':05:09Z"')
         ELSE concat('"', d, ' ', lpad(cast(k % 24 AS string), 2, '0'), ':05:09.250+05:00"') END AS ets,
    CASE WHEN k % 10 = 9 THEN concat('{"note": "', memo, '", "channel": "', channel, '", "amount_pkr": ', cents, '}')
         ELSE concat('{"account_holder": "', account_holder, '", "cnic": "', cnic, '", "iban_from": "', iban_from,
                     '", "iban_to": "', iban_to, '", "phone": "', phone, '", "email": "', email, '", "channel": "', channel,
                     '", "memo": "', memo, '", "amount_pkr": ', cents, '}') END AS payload
  FROM (SELECT x.*, substr(cast(event_ts AS string), 1, 10) AS d, cast(cast(round(amount_pkr) AS bigint) AS string) AS cents FROM txn x) t
) r
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Tasks per core that transactions are dealt to.
WAVES = 2


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when a scan yields fewer splits than there are cores.

    Detection is bound by CPU, not by reading; a small file with one row group would run
    in one task. Large inputs have more splits than cores and are left alone.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bank transaction per order. A projection: only four columns are read."""
    columns = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    orders = table(spark, sf_dir, "orders").select(*columns)
    # Dealt out evenly at any size: splits hold whole row groups, so of many splits a few may have
    # all rows, and what follows costs far more than moving four narrow columns.
    slots = spark.sparkContext.defaultParallelism
    orders = orders.repartition(max(WAVES * slots, orders.rdd.getNumPartitions()))
    return spark.sql(TXN_SQL.replace("FROM orders o", "FROM {orders} o"), orders=orders)


def txn_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text members of every transaction as (k, message_id, field, value) rows."""
    pairs = ", ".join(f"'{c}', {c}" for c in TXN_TEXT_FIELDS)
    return txn(spark, sf_dir).selectExpr(
        "k", "message_id", f"stack({len(TXN_TEXT_FIELDS)}, {pairs}) AS (field, value)"
    )


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as a broker delivers them: bytes with topic, partition, offset."""
    txn(spark, sf_dir).createOrReplaceTempView("redactstream_txn")
    sql = (
        RAW_SQL.replace("FROM txn x", "FROM redactstream_txn x")
        .replace("k // 97", "k div 97")
        .replace('"partition"', "`partition`")
        .replace('"offset"', "`offset`")
    )
    body = F.encode("body", "UTF-8").alias("value")
    return spark.sql(sql).select(body, "topic", "partition", "offset", "k")
