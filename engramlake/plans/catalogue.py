"""Configuration rows for the bound world: attributes, ratio pairs, relation types."""

ATTR_SCHEMA = (
    "attr string, dtype string, min_val double, max_val double, unit string, label string, "
    "agg_ops array<string>, choices array<string>, position int"
)

# The attributes of the bound world.
ATTR_DEFS = [
    ("acctbal", "float", -1000.0, 10000.0, "$", "account balance", ["total", "average"], [], 1),
    ("order_count", "int", 0.0, 1000000.0, "", "order count", ["total", "average"], [], 2),
    ("total_spend", "float", 0.0, 1.0e12, "$", "total spend", ["average"], [], 3),
    ("priority", "enum", None, None, "", "top priority", [],
     ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 4),
    ("last_order", "date", 1990.0, 2005.0, "", "last order", [], [], 5),
]

RATIO_SCHEMA = "attr1 string, attr2 string, label string"
RATIO_PAIRS = [("total_spend", "order_count", "spend per order"), ("acctbal", "order_count", "balance per order")]

RELATION_SCHEMA = "relation string, symmetric boolean"
RELATIONS = [("supplies", False), ("audits", False)]
