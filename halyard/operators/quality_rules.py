"""Validation rules as data.

fixed values: the expectations every delivered table set is held to.
"""

PRIMARY_KEYS = {
    "customers": "customer_id",
    "products": "product_id",
    "suppliers": "supplier_id",
    "employees": "employee_id",
    "marketing_campaigns": "campaign_id",
    "orders": "order_id",
}

FOREIGN_KEYS = [
    ("products", "supplier_id", "suppliers", "supplier_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "product_id", "products", "product_id"),
    ("orders", "campaign_id", "marketing_campaigns", "campaign_id"),
    ("inventory_snapshots", "product_id", "products", "product_id"),
    ("customer_kpis", "customer_id", "customers", "customer_id"),
]

REQUIRED_COLUMNS = {
    "customers": [
        "customer_id", "customer_name", "segment", "industry", "region", "country", "signup_date", "employee_count",
        "annual_revenue", "engagement_score", "customer_health_score", "churn_risk_score", "churn_flag",
    ],
    "products": [
        "product_id", "product_name", "category", "subcategory", "supplier_id", "unit_cost", "list_price",
        "margin_rate", "demand_score", "lifecycle_stage", "is_active",
    ],
    "suppliers": [
        "supplier_id", "supplier_name", "supplier_type", "region", "country", "lead_time_days", "reliability_score",
        "contract_value",
    ],
    "employees": [
        "employee_id", "employee_name", "department", "level", "region", "hire_date", "salary", "performance_score",
        "manager_id", "is_active",
    ],
    "marketing_campaigns": [
        "campaign_id", "campaign_name", "channel", "target_segment", "start_date", "end_date", "budget",
        "leads_generated", "conversion_rate", "attributed_revenue",
    ],
    "orders": [
        "order_id", "customer_id", "product_id", "campaign_id", "order_date", "sales_channel", "order_status",
        "quantity", "unit_price", "discount_rate", "order_amount", "shipping_days", "category", "gross_margin",
        "order_month",
    ],
    "inventory_snapshots": [
        "snapshot_date", "warehouse_id", "product_id", "on_hand_units", "reserved_units", "reorder_point",
        "stockout_risk", "inventory_value",
    ],
    "finance_monthly": [
        "order_month", "revenue", "gross_margin", "order_count", "cogs", "opex", "ebitda", "cash_balance",
        "debt_balance", "dscr",
    ],
    "operations_daily": [
        "operating_date", "warehouse_id", "throughput_units", "on_time_delivery_rate", "fulfillment_rate",
        "incident_count", "labor_hours", "downtime_minutes",
    ],
    "customer_kpis": [
        "customer_id", "segment", "industry", "region", "country", "signup_date", "employee_count", "annual_revenue",
        "engagement_score", "customer_health_score", "churn_risk_score", "churn_flag", "total_orders",
        "total_revenue", "recent_order_count", "recent_revenue", "recent_avg_discount", "recent_avg_shipping_days",
        "recent_last_order", "days_since_last_order", "order_velocity", "revenue_90d_target",
    ],
}

# column: (lowest, highest), None meaning open
NUMERIC_RANGES = {
    "customers": {
        "engagement_score": (0, 100),
        "customer_health_score": (0, 100),
        "churn_risk_score": (0, 100),
        "churn_flag": (0, 1),
    },
    "products": {"unit_cost": (0, None), "list_price": (0, None), "margin_rate": (0, 1), "demand_score": (0, 100)},
    "suppliers": {"lead_time_days": (0, None), "reliability_score": (0, 100), "contract_value": (0, None)},
    "employees": {"salary": (0, None), "performance_score": (0, 100), "is_active": (0, 1)},
    "marketing_campaigns": {
        "budget": (0, None),
        "leads_generated": (0, None),
        "conversion_rate": (0, 1),
        "attributed_revenue": (0, None),
    },
    "orders": {
        "quantity": (1, None),
        "unit_price": (0, None),
        "discount_rate": (0, 1),
        "order_amount": (0, None),
        "shipping_days": (0, None),
        "gross_margin": (0, None),
    },
    "inventory_snapshots": {
        "on_hand_units": (0, None),
        "reserved_units": (0, None),
        "reorder_point": (0, None),
        "stockout_risk": (0, 1),
        "inventory_value": (0, None),
    },
    "finance_monthly": {
        "revenue": (0, None),
        "gross_margin": (None, None),
        "cogs": (0, None),
        "opex": (0, None),
        "ebitda": (None, None),
        "cash_balance": (0, None),
        "debt_balance": (0, None),
        "dscr": (0, None),
    },
    "operations_daily": {
        "throughput_units": (0, None),
        "on_time_delivery_rate": (0, 1),
        "fulfillment_rate": (0, 1),
        "incident_count": (0, None),
        "labor_hours": (0, None),
        "downtime_minutes": (0, None),
    },
    "customer_kpis": {
        "total_orders": (0, None),
        "total_revenue": (0, None),
        "recent_order_count": (0, None),
        "days_since_last_order": (0, None),
        "order_velocity": (0, None),
        "revenue_90d_target": (0, None),
        "churn_flag": (0, 1),
    },
}

MINIMUM_ROWS = {
    "customers": 10_000,
    "products": 1_000,
    "suppliers": 100,
    "employees": 500,
    "marketing_campaigns": 1_000,
    "orders": 100_000,
    "inventory_snapshots": 100_000,
    "finance_monthly": 12,
    "operations_daily": 365,
    "customer_kpis": 10_000,
}
