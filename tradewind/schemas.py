"""Fixed schemas of the source files and of the tables the models write."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
COORDINATE = T.DecimalType(18, 10)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()

BRONZE = {
    "orders": _struct(
        ("order_id", _S), ("customer_id", _S), ("order_status", _S),
        ("order_purchase_timestamp", _S), ("order_approved_at", _S),
        ("order_delivered_carrier_date", _S), ("order_delivered_customer_date", _S),
        ("order_estimated_delivery_date", _S),
    ),
    "customers": _struct(
        ("customer_id", _S), ("customer_unique_id", _S), ("customer_zip_code_prefix", _L),
        ("customer_city", _S), ("customer_state", _S),
    ),
    "order_items": _struct(
        ("order_id", _S), ("order_item_id", _L), ("product_id", _S), ("seller_id", _S),
        ("shipping_limit_date", _S), ("price", MONEY), ("freight_value", MONEY),
    ),
    "order_payments": _struct(
        ("order_id", _S), ("payment_sequential", _L), ("payment_type", _S),
        ("payment_installments", _L), ("payment_value", MONEY),
    ),
    "order_reviews": _struct(
        ("review_id", _S), ("order_id", _S), ("review_score", _L),
        ("review_comment_title", _S), ("review_comment_message", _S),
        ("review_creation_date", _S), ("review_answer_timestamp", _S),
    ),
    "products": _struct(
        ("product_id", _S), ("product_category_name", _S), ("product_name_lenght", _L),
        ("product_description_lenght", _L), ("product_photos_qty", _L), ("product_weight_g", _D),
        ("product_length_cm", _D), ("product_height_cm", _D), ("product_width_cm", _D),
    ),
    "sellers": _struct(
        ("seller_id", _S), ("seller_zip_code_prefix", _L), ("seller_city", _S), ("seller_state", _S),
    ),
    "geolocation": _struct(
        ("geolocation_zip_code_prefix", _L), ("geolocation_lat", _D), ("geolocation_lng", _D),
        ("geolocation_city", _S), ("geolocation_state", _S),
    ),
    "product_category_name_translation": _struct(
        ("product_category_name", _S), ("product_category_name_english", _S),
    ),
}

# Tables the model jobs own; a write that does not fit fails before it starts.
SCORED = {
    "customer_segments": _struct(
        ("customer_unique_id", _S), ("segment_id", _L), ("segment_name", _S), ("recency_days", _D),
        ("frequency", _L), ("monetary", _D), ("rfm_score", _D), ("model_run_id", _S), ("scored_at", _TS),
    ),
    "customer_repeat_purchase_scores": _struct(
        ("customer_unique_id", _S), ("repeat_probability", _D), ("repeat_prediction", T.BooleanType()),
        ("model_run_id", _S), ("scored_at", _TS), ("model_version", _S),
    ),
    "repeat_purchase_feature_importance": _struct(
        ("feature", _S), ("importance", _D), ("model_run_id", _S), ("scored_at", _TS),
    ),
    "repeat_purchase_model": _struct(
        ("shard", T.IntegerType()), ("round", T.IntegerType()), ("node", T.IntegerType()), ("feature", T.IntegerType()),
        ("threshold", _D), ("value", _D), ("gain", _D), ("cover", _D), ("model_run_id", _S), ("scored_at", _TS),
    ),
    "demand_forecasts": _struct(
        ("category", _S), ("week", T.DateType()), ("yhat", _D), ("yhat_lower", _D), ("yhat_upper", _D),
        ("model_run_id", _S), ("model", _S), ("scored_at", _TS),
    ),
}

# One order event on the wire; the payload is the order row plus the time it was sent.
ORDER_EVENT = _struct(
    *[(f.name, f.dataType) for f in BRONZE["orders"].fields], ("event_timestamp", _S),
)
