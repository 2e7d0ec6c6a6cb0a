"""Declared schemas of the tables that enter and leave the library."""

from pyspark.sql.types import StringType, StructField, StructType

# The columns of a raw offer, in file order.
RAW_OFFER_COLUMNS = (
    "captured_on", "store", "category", "url", "image", "name", "brand", "seller",
    "rating", "list_price", "store_price", "partner_price", "other_price",
)

RAW_OFFERS = StructType([StructField(c, StringType()) for c in RAW_OFFER_COLUMNS])

# Sentinels written by the collectors.
MISSING_FIELD = "Na"
STATUS_PROPERTY = "Estado del producto"
UNAVAILABLE = "Producto no disponible"
NO_COMMENT = "sin comentarios"
NO_SCORE = "sin score"
