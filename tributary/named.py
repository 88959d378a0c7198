"""The named queries: streams, edges and filters of known workloads, over tables by stream number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tributary.query import JoinQuery
from tributary.sources import schemas as S

#: For each query, the stream names by number, and their columns.
STREAMS: dict[str, list[tuple[str, T.StructType]]] = {
    "tpcds_qx": [("sr", S.STORE_RETURNS), ("cs", S.CATALOG_SALES), ("d1", S.DATE_DIM), ("d2", S.DATE_DIM), ("ss", S.STORE_SALES)],
    "tpcds_qy": [("ss", S.STORE_SALES), ("c2", S.CUSTOMER), ("hd1", S.HOUSEHOLD_DEMOGRAPHICS), ("hd2", S.HOUSEHOLD_DEMOGRAPHICS), ("c1", S.CUSTOMER)],
    "tpcds_qz": [
        ("ss", S.STORE_SALES), ("c2", S.CUSTOMER), ("i2", S.ITEM), ("hd1", S.HOUSEHOLD_DEMOGRAPHICS), ("hd2", S.HOUSEHOLD_DEMOGRAPHICS),
        ("c1", S.CUSTOMER), ("i1", S.ITEM),
    ],
    "edgar": [(f"r{i}", S.EDGAR) for i in range(3)],
    "f": [("i", S.ITEM), ("ss", S.STORE_SALES), ("d", S.DATE_DIM)],
}


def streams_of(name: str, lanes: int = 3) -> list[tuple[str, T.StructType]]:
    return [(f"lane{i}", S.LINEAR_ROAD) for i in range(lanes)] if name == "linear_road" else STREAMS[{"s": "tpcds_qx", "t": "tpcds_qy"}.get(name, name)]


def build(name: str, frames: list[DataFrame], algorithm: str = "folded", rid: str = "line_no", width: int = 0) -> JoinQuery:
    """A named query; frames: a table for each stream number, with a column `rid` that names its rows."""
    # The keys, edges and filters that each workload consists of.
    q = JoinQuery(algorithm)
    ts = "ts" if name == "edgar" else "time"
    keys = {"d1": "date_sk", "d2": "date_sk", "d": "date_sk", "c1": "customer_sk", "hd1": "demo_sk", "hd2": "demo_sk", "i1": "item_sk", "i": "item_sk"}
    if name in ("tpcds_qx", "s"):
        keys["ss"] = "item_sk_and_ticket_number"
    for (stream, _), frame in zip(streams_of(name, len(frames)), frames):
        q.add_stream(stream, frame, rid=rid, ts=ts, primary_key=keys.get(stream, ()))
    if name == "linear_road":
        for i in range(len(frames) - 1):
            q.add_band_join(f"lane{i}", "pos", f"lane{i + 1}", "pos", width)
    elif name in ("tpcds_qx", "s"):
        q.add_equi_join("sr", "item_sk_and_ticket_number", "ss", "item_sk_and_ticket_number", foreign_key="sr")
        q.add_equi_join("sr", "returned_date_sk", "d1", "date_sk", foreign_key="sr")
        q.add_equi_join("cs", "sold_date_sk", "d2", "date_sk", foreign_key="cs")
        q.add_equi_join("sr", "customer_sk", "cs", "bill_customer_sk")
        q.add_neq_filter("sr", "returned_date_sk", 0).add_neq_filter("cs", "sold_date_sk", 0)
    elif name in ("tpcds_qy", "tpcds_qz", "t"):
        q.add_equi_join("ss", "customer_sk", "c1", "customer_sk", foreign_key="ss")
        q.add_equi_join("c1", "current_hdemo_sk", "hd1", "demo_sk", foreign_key="c1")
        q.add_equi_join("c2", "current_hdemo_sk", "hd2", "demo_sk", foreign_key="c2")
        q.add_equi_join("hd1", "income_band_sk", "hd2", "income_band_sk")
        q.add_neq_filter("ss", "customer_sk", 0).add_neq_filter("c1", "current_hdemo_sk", 0).add_neq_filter("c2", "current_hdemo_sk", 0)
        if name == "tpcds_qz":
            q.add_equi_join("ss", "item_sk", "i1", "item_sk", foreign_key="ss")
            q.add_equi_join("i1", "category_id", "i2", "category_id")
    elif name == "edgar":
        q.add_equi_join("r0", "ip24", "r1", "ip24").add_equi_join("r1", "ip24", "r2", "ip24")
    elif name == "f":
        q.add_equi_join("ss", "item_sk", "i", "item_sk", foreign_key="ss").add_equi_join("ss", "sold_date_sk", "d", "date_sk", foreign_key="ss")
        q.add_equi_filter("i", "manufact_id", 128)
    return q
