"""Column lists of the known inputs: fixed values that files are laid out by."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType(), "long": T.LongType(), "date": T.DateType(), "double": T.DoubleType(), "string": T.StringType()}


def schema(text: str) -> T.StructType:
    """From "name name:kind ..."; long where no kind is given."""
    parts = [c.partition(":") for c in text.split()]
    return T.StructType([T.StructField(name, _KINDS[kind or "long"]) for name, _, kind in parts])


# Columns of the input lines, in order.
STORE_SALES = schema(
    "time sold_date_sk sold_time_sk item_sk customer_sk cdemo_sk hdemo_sk addr_sk store_sk promo_sk ticket_number quantity item_sk_and_ticket_number"
)
STORE_RETURNS = schema(
    "time returned_date_sk return_time_sk item_sk customer_sk cdemo_sk hdemo_sk addr_sk store_sk reason_sk ticket_number item_sk_and_ticket_number"
)
CATALOG_SALES = schema(
    "time sold_date_sk sold_time_sk ship_date_sk bill_customer_sk bill_cdemo_sk bill_hdemo_sk bill_addr_sk ship_customer_sk ship_cdemo_sk "
    "ship_hdemo_sk ship_addr_sk call_center_sk catalog_page_sk ship_mode_sk warehouse_sk item_sk promo_sk order_number"
)
WEB_SALES = schema(
    "time sold_date_sk sold_time_sk ship_date_sk item_sk bill_customer_sk bill_cdemo_sk bill_hdemo_sk bill_addr_sk ship_customer_sk ship_cdemo_sk "
    "ship_hdemo_sk ship_addr_sk web_page_sk web_site_sk web_ship_mode_sk warehouse_sk promo_sk order_number quantity item_sk_and_sold_date_sk"
)
INVENTORY = schema("time date_sk item_sk warehouse_sk quantity_on_hand item_sk_and_date_sk")
DATE_DIM = schema("time date_sk date_id:string date:date month_seq week_seq quarter_seq year dow moy dom qoy")
ITEM = schema(
    "time item_sk item_id:string rec_start_date:date rec_end_date:date item_desc:string current_price:double wholesale_cost:double brand_id brand:string "
    "class_id class:string category_id category:string manufact_id manufact:string"
)
CUSTOMER = schema("time customer_sk customer_id:string current_cdemo_sk current_hdemo_sk")
HOUSEHOLD_DEMOGRAPHICS = schema("time demo_sk income_band_sk buy_potential:string dep_count vehicle_count")
LINEAR_ROAD = schema(
    "type:int time carid:int speed:int xway:int lane:int dir:int seg:int pos:int qid:int sinit:int send:int dow:int tod:int day:int"
)
EDGAR = schema(
    "ts ip ip24:int original_ts date:date time:string zone:int cik:double accession:string doc:string code:int size idx:int norefer:int noagent:int "
    "find:int crawler:int browser:string"
)
#: Columns that a reader cuts to so many bytes.
WIDTHS = {"date_id": 18, "item_id": 18, "item_desc": 210, "brand": 52, "class": 52, "category": 52, "manufact": 52, "customer_id": 18, "buy_potential": 17}
