"""Fixed schemas of the model."""

from __future__ import annotations

from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    """A file's schema: every cell is text, and a blank cell stands for a missing value."""
    return T.StructType([T.StructField(x, T.StringType()) for x in names])


def _typed(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

CATALOGUE = strings("item_code", "item_name", "description", "brand", "item_group", "stock_uom", "uom_conversions", "barcode", "manufacturer_part_no", "disabled", "available_qty", "list_price")
CUSTOMER_SKU_MAP = strings("tenant", "customer_id", "customer_sku", "item_code", "customer_description", "valid_from", "valid_to", "source", "confidence")
ORDER_LINES = strings("line_id", "tenant", "customer_id", "channel", "order_date", "raw_text", "qty", "uom_text", "unit_price", "buyer_sku", "raw_barcode", "notes")
ORDER_LINES_LABELLED = strings(*ORDER_LINES.names, "gt_item_code")
HOLDOUT_LABELS = strings("line_id", "gt_item_code", "gt_class")
UOM_REFERENCE = strings("tenant", "item_code", "uom", "conversion_factor", "is_stock_uom")
PREDICTIONS = strings("line_id", "item_code", "confidence", "decision", "reason_code", "candidates")

UOM_CONVERSIONS = T.ArrayType(_typed(uom=S, conversion_factor=D))

TENANT = _typed(tenant_id=S, name=S, plan=S)
ORDER_LINE = _typed(line_id=S, tenant_id=S, customer_id=S, channel=S, created_at=S, raw_text=S)
MATCH_EVENT = _typed(event_id=L, tenant_id=S, line_id=S, item_code=S, stage=S, score=D, rank=I, accepted=I, latency_ms=I, created_at=S)
ITEM = _typed(tenant_id=S, item_code=S, item_name=S, item_group=S, disabled=I)

PAYLOAD = _typed(name=S, price=D, uom=S)
REMOTE_RECORD = _typed(external_id=S, payload=PAYLOAD, version=I, updated_at=S)
LOCAL_RECORD = _typed(external_id=S, payload=PAYLOAD, remote_version=I, updated_at_utc=S, dirty=T.BooleanType(), mutation_id=I)
WRITE_LOG = _typed(external_id=S, version=I, payload=PAYLOAD)
APPLIED_LOG = _typed(external_id=S, remote_version=I)
