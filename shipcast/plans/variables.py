"""Variable lists of the analyses (fixed values: names as in the analysed data).

Where the two order-level analyses give one name two meanings, the column
names of ``operators.features`` are used: ``purchase_yr_frac`` /
``est_delivery_yr_frac`` (year + (month-1)/12), ``purchase_mo_name``,
``purchase_day_name``, ``est_delivery_mo_name``, ``est_delivery_day_name``
(names), and ``purchase_mo`` / ``purchase_yr_and_mo`` / ``purchase_day_of_wk``
(numbers, yyyymm, Monday = 0).
"""

REG_TARGET = "fulfill_duration"
CLF_TARGET = "late_delivery_flag"

# regression correlation list (29)
REG_CORR_VARS = [
    "fulfill_duration", "est_delivery_time_days", "distance_km", "approval_time_days", "ttl_pd", "ttl_price",
    "ttl_freight", "pmt_mthds_used", "installments_used_ttl", "payment_types_used", "nbr_items", "nbr_sellers",
    "nbr_products", "nbr_photos", "ttl_wt", "ttl_length", "ttl_height", "ttl_width", "purchase_yr_frac",
    "est_delivery_yr_frac", "states_same_or_diff", "lat_customer", "long_customer", "lat_seller", "long_seller",
    "shipping_limit_miss_amt", "days_remaining", "late_delivery_flag", "shipping_limit_missed",
]
# known only after the fact: dropped from the predictor ranking
LATE_KNOWN_VARS = ["late_delivery_flag", "days_remaining", "shipping_limit_missed", "shipping_limit_miss_amt"]

# regression model 1 and random forests (19)
REG_PREDICTORS = [
    "distance_km", "est_delivery_time_days", "states_same_or_diff", "ttl_freight", "purchase_yr_frac",
    "est_delivery_yr_frac", "ttl_pd", "ttl_wt", "ttl_price", "installments_used_ttl", "ttl_height", "nbr_sellers",
    "ttl_length", "nbr_photos", "nbr_products", "nbr_items", "ttl_width", "pmt_mthds_used", "payment_types_used",
]
# regression model 3: the promised estimate only
REG_ESTIMATE_ONLY = ["est_delivery_time_days"]

REG_LOWCARD = ["customer_state", "seller_state", "product_ctgry_mfu", "payment_type_mfu", "purchase_mo_name",
               "purchase_yr_frac", "purchase_day_name", "est_delivery_mo_name", "est_delivery_day_name"]
REG_HICARD = ["customer_zip_code_prefix", "customer_city", "seller_id", "seller_zip_code_prefix", "seller_city",
              "state_pair"]

# classifier exploration
CLF_CONT_EDA = ["shipping_limit_miss_amt", "days_remaining", "distance_km", "approval_time_days", "ttl_wt",
                "est_delivery_time_days", "ttl_height", "ttl_length", "ttl_width"]
CLF_CATEGORICAL = ["customer_zip_code_prefix", "customer_city", "customer_state", "seller_id",
                   "seller_zip_code_prefix", "seller_city", "seller_state", "product_ctgry_mfu",
                   "shipping_limit_missed", "nbr_sellers", "nbr_products", "nbr_photos", "purchase_mo",
                   "purchase_yr_and_mo", "purchase_day_of_wk", "state_pair", "states_same_or_diff"]
CLF_LOWCARD = ["customer_state", "seller_state", "product_ctgry_mfu"]
CLF_HICARD = ["customer_city", "seller_city", "customer_zip_code_prefix", "seller_zip_code_prefix", "seller_id",
              "state_pair"]
CLF_BASIC = ["est_delivery_time_days", "shipping_limit_missed", "shipping_limit_miss_amt", "days_remaining",
             "distance_km", "approval_time_days", "nbr_items", "nbr_sellers", "nbr_products", "ttl_pd", "ttl_wt",
             "ttl_length", "ttl_height", "ttl_width", "states_same_or_diff"]
# predictors that depend on what has happened by the decision time; the others are known at purchase
KNOWN_MASKED = ["shipping_limit_missed", "shipping_limit_miss_amt", "days_remaining", "approval_time_days"]
CLF_NOT_SCALED = ["states_same_or_diff", "shipping_limit_missed"]

# item-level numeric columns of the timeline correlation (numeric columns minus
# the row id, item number, payment sequence and product text lengths)
ITEM_NUMERIC = ["lat_seller", "long_seller", "lat_customer", "long_customer", "payment_installments",
                "payment_value", "price", "freight_value", "review_score", "delivery_hours", "distance_km",
                "late_flag"]
ITEM_NUMERIC_EXT = ITEM_NUMERIC + ["carrier_to_customer_hours"]

# outlier rules of the classifier preparation
SHIP_MISS_TRIM = -60.0      # shipping_limit_miss_amt below this is an outlier
DISTANCE_MAX_KM = 3400.0    # keep distance_km strictly below this
