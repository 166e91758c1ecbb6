"""Labels, texts, weights and patterns that results must carry verbatim."""

# Source codes the rules test for.
ACTIVE_STATUS = "Active"
PRIMARY_ADDRESS = "Primary"
COMPLETED_STATUS = "Completed"

# Probabilities, from the longest absence to the shortest.
CHURN_PROBABILITIES = ("0.8", "0.5", "0.3", "0.1", "0.05")
PURCHASE_PROPENSITIES = ("0.8", "0.6", "0.4", "0.2")

# Loyalty weights and limits.
LOYALTY_ORDER_WEIGHT = "0.6"
LOYALTY_KEPT_WEIGHT = "0.4"
LOYALTY_PLAIN_WEIGHT = "0.4"
LOYALTY_SCALE = 10
LOYALTY_MAX_RETURN_RATE = 10

# Stand-in for an unknown last purchase when scoring recency.
UNKNOWN_RECENCY_DAYS = 999999

# Customer health.
HEALTH_CHURN_LIMIT = "0.7"
HEALTH_LEVELS = (("0.8", "Excellent"), ("0.6", "Good"), ("0.4", "Average"))
HEALTH_AT_RISK = "At Risk"
HEALTH_REST = "Needs Attention"

# Segment names.
VALUE_SEGMENTS = ("High Value", "Medium Value", "Low Value")
BEHAVIOR_SEGMENTS = (
    "Champions",
    "Loyal Customers",
    "Potential Loyalists",
    "At Risk",
    "Hibernating",
    "Lost",
    "Others",
)
LIFECYCLE_SEGMENTS = ("New Customer", "Active", "At Risk", "Churned", "Inactive")
TARGET_GROUPS = (
    "VIP",
    "Retention Priority",
    "Nurture New",
    "Growth Opportunity",
    "Service Improvement",
    "Standard",
)
SEGMENT_DOMAINS = {
    "ValueSegment": VALUE_SEGMENTS,
    "BehaviorSegment": BEHAVIOR_SEGMENTS,
    "LifecycleSegment": LIFECYCLE_SEGMENTS,
    "TargetGroup": TARGET_GROUPS,
}
CHAMPION_SCORE = 13

# Limits shared by lifecycle, target group and recommendation.
CHURN_LOW_LIMIT = "0.3"
CHURN_HIGH_LIMIT = "0.7"
NEW_CUSTOMER_DAYS = 30
GROWTH_PROPENSITY = "0.6"
SERVICE_RETURN_RATE = 20

# Recommendation texts, one per target group.
RECOMMEND_VIP = "Exclusive offers, VIP events, Personal shopping assistance, Early access to new products"
RECOMMEND_RETENTION = (
    "Re-engagement campaign, Loyalty rewards, Personalized recommendations based on past purchases"
)
RECOMMEND_NEW = "Welcome series, Educational content, First purchase follow-up, Category exploration"
RECOMMEND_GROWTH = ("Cross-sell/upsell, Bundle offers based on ", "preferred category", ", Category expansion")
RECOMMEND_SERVICE = "Satisfaction survey, Improved product information, Size/fit guides, Service recovery"
RECOMMEND_STANDARD = (
    "Standard seasonal promotions, Category newsletters, Reactivation after ",
    " months",
)
DAYS_PER_MONTH = 30

# The simplified rule sets.
SIMPLE_SPEND_LIMITS = ("5000", "2500")
SIMPLE_ORDER_LIMITS = (10, 5)
SIMPLE_DAY_LIMITS = (30, 90)

# Steps of a run as the log names them, each with its closing message.
STEP_INITIALIZE = "Initialize"
START_MESSAGE = "Starting Customer Analytics processing for date: {day} - Type: {kind}"
STEP_BASE = ("Extract Customer Base", "Extracted base customer data")
STEP_SUMMARY = ("Process Transaction Summary", "Calculated transaction summary metrics")
STEP_METRICS = ("Calculate Customer Metrics", "Calculated advanced customer metrics")
STEP_SEGMENTS = ("Customer Segmentation", "Completed customer segmentation")
STEP_PERSIST = ("Data Persistence", "Data persistence completed")
STEP_REPORT = ("Generate Summary", "Summary statistics generated")
ERROR_PREFIX = "ERROR: "

# Run status words.
STATUS_SUCCESS = "Success"
STATUS_FAILED = "Failed"

# Text patterns and block markers.
TABLE_AFTER_FROM = r"(?i)FROM\s+([a-zA-Z0-9_\.]+)"
TABLE_AFTER_JOIN = r"(?i)JOIN\s+([a-zA-Z0-9_\.]+)"
CTE_AFTER_WITH = r"(?i)WITH\s+([a-zA-Z0-9_]+)\s+AS"
LANGUAGE_FENCE = r"```(?:python|pyspark)?\s*([\s\S]*?)```"
STAGE_MARKERS = (
    ("bronze_layer", "# BRONZE LAYER START"),
    ("stage1_base_data", "# STAGE 1: BASE DATA START"),
    ("silver_layer", "# SILVER LAYER START"),
    ("stage2_advanced_analytics", "# STAGE 2: ADVANCED ANALYTICS START"),
    ("gold_layer", "# GOLD LAYER START"),
)
SNIPPET_CHARS = 300
