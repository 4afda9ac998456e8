"""Table schemas and the extraction record."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MONEY = T.DecimalType(15, 2)
QUANTITY = T.DecimalType(15, 3)
SCORE = T.DecimalType(5, 4)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


VENDORS = _table(
    id=T.StringType(), name=T.StringType(), nit=T.StringType(), address=T.StringType(),
    phone=T.StringType(), email=T.StringType(), created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
STORES = _table(
    id=T.StringType(), name=T.StringType(), code=T.StringType(), address=T.StringType(), city=T.StringType(),
)
PRODUCTS = _table(
    id=T.StringType(), master_name=T.StringType(), master_sku=T.StringType(),
    category=T.StringType(), unit=T.StringType(),
)
PRODUCT_MAPPINGS = _table(
    id=T.StringType(), product_id=T.StringType(), vendor_id=T.StringType(),
    vendor_name=T.StringType(), vendor_sku=T.StringType(),
)
INVOICES = _table(
    id=T.StringType(), invoice_number=T.StringType(), vendor_id=T.StringType(), store_id=T.StringType(),
    invoice_date=T.DateType(), due_date=T.DateType(), subtotal=MONEY, tax=MONEY, total=MONEY,
    source_file_path=T.StringType(), source_file_id=T.StringType(), confidence_score=SCORE,
    processing_status=T.StringType(), error_message=T.StringType(), validated=T.BooleanType(),
    validated_by=T.StringType(), validated_at=T.TimestampType(), raw_ocr_text=T.StringType(),
    structured_data=T.StringType(), created_at=T.TimestampType(), updated_at=T.TimestampType(),
)
INVOICE_ITEMS = _table(
    id=T.StringType(), invoice_id=T.StringType(), product_id=T.StringType(),
    vendor_product_name=T.StringType(), vendor_sku=T.StringType(), quantity=QUANTITY,
    unit_price=MONEY, line_total=MONEY, line_number=T.IntegerType(), matched=T.BooleanType(),
    manufacturer_id=T.StringType(), manufacturer_prefix=T.StringType(), product_name_clean=T.StringType(),
)
PROCESSING_LOG = _table(
    id=T.StringType(), invoice_id=T.StringType(), event_type=T.StringType(), status=T.StringType(),
    message=T.StringType(), details=T.StringType(), created_at=T.TimestampType(),
)

# Allowed states of the data model.
PROCESSING_STATUSES = ["pending", "processing", "processed", "error", "manual_review", "validated"]
QUEUE_STATUSES = ["pending", "processing", "completed", "failed"]
EVENT_TYPES = [
    "uploaded", "ocr_started", "ocr_completed", "ner_started", "ner_completed", "normalized", "validated", "error",
]
LOG_STATUSES = ["success", "error", "warning", "info"]

# The extraction record is read in two steps, because only a map tells a missing
# key from an explicit null: first these maps, then the typed record below.
TEXT_MAP = T.MapType(T.StringType(), T.StringType())
TEXT_MAPS = T.ArrayType(TEXT_MAP)

ITEM = T.ArrayType(_table(
    product_name=T.StringType(), sku=T.StringType(), quantity=T.DoubleType(),
    unit_price=T.DoubleType(), line_total=T.DoubleType(),
))


def natural_id(*key: Column | str) -> Column:
    """Deterministic row id: a hash of the natural key (stable on recompute)."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("\u0000")) for k in key]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)
