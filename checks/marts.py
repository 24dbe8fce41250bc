"""The six marts."""

from checks.registry import query

CUSTOMER = (
    "customer_id region city_tier preferred_channel loyalty_tier income_band customer_segment_seed is_marketing_opt_in:b"
    " signup_date:d total_orders:i total_net_revenue:f avg_order_value:f total_discount_amount:f avg_basket_size:f"
    " first_order_date:d last_order_date:d recency_days:i tenure_days:i revenue_per_order:f online_order_share:f"
    " store_order_share:f total_units:i avg_item_discount_pct:f avg_item_margin:f total_returns:i total_refund_amount:f"
    " avg_days_to_return:f return_rate_per_unit:f total_sessions:i avg_session_minutes:f avg_pages_viewed:f"
    " sessions_add_to_cart:i sessions_with_purchase:i campaigns_targeted:i campaigns_treatment:i campaigns_converted_30d:i"
    " campaign_revenue_30d:f churn_flag_90d:i customer_value_band spend_rank_in_region:i"
)
DEMAND = (
    "week_start_date:d product_id store_id_or_online category subcategory price_tier seasonal_flag:b premium_flag:b"
    " units_sold:i order_line_count:i net_revenue:f avg_item_discount_pct:f avg_listed_price:f avg_discount_pct:f"
    " promo_days:i markdown_days:i avg_starting_inventory:f avg_ending_inventory:f stock_received_units:i stockout_days:i"
    " backorder_days:i lag_1w_units_sold:i lag_4w_units_sold:i rolling_4w_avg_units:f rolling_4w_revenue:f weekly_demand_band"
)
CAMPAIGN = (
    "campaign_id campaign_name campaign_type campaign_channel offer_type offer_strength:f customer_id assignment_datetime:t"
    " treatment_flag:b control_flag:b predicted_business_segment_at_send targeting_rule_source delivered_flag:i open_flag:i"
    " click_flag:i unsubscribe_flag:i conversion_within_7d:i conversion_within_30d:i revenue_within_7d:f revenue_within_30d:f"
    " source_event_rows:i pre_90d_orders:i pre_90d_revenue:f pre_90d_aov:f response_flag_30d:i response_bucket"
    " campaign_response_rank:i revenue_decile_within_campaign:i"
)
RETURNS = (
    "order_item_id order_id customer_id product_id order_date:d channel payment_type category subcategory price_tier region"
    " loyalty_tier quantity:i item_list_price:f item_discount_pct:f item_net_price:f item_cost:f item_margin:f"
    " fulfillment_type return_flag:i return_id return_reason return_status return_channel refund_amount:f days_to_return:i"
    " discount_band return_risk_seed:f prior_customer_return_rate:f recent_product_return_events:i return_risk_band"
    " customer_item_recency_rank:i"
)
INTERACTIONS = (
    "customer_id product_id category subcategory price_tier brand_type color material_type recommendation_embedding_group"
    " active_days:i total_interactions:i total_interaction_value:f interaction_score:f first_interaction_date:d"
    " last_interaction_date:d recency_days:i product_rank_for_customer:i category_rank_for_customer:i"
)
STORE = (
    "week_start_date:d store_id_or_online region city store_type store_size_band order_count:i net_revenue:f"
    " discount_amount:f avg_basket_size:f campaign_attributed_orders:i units_sold:i item_margin:f avg_item_discount_pct:f"
    " avg_starting_inventory:f avg_ending_inventory:f stock_received_units:i stockout_days:i backorder_days:i"
    " avg_discount_pct:f promo_days:i markdown_days:i running_revenue:f rolling_4w_avg_revenue:f lag_1w_revenue:f"
    " performance_band"
)


@query("mart_01_customer_features", CUSTOMER, "SELECT * FROM m_customer")
def _(x):
    return x.mart("customer_features")


@query("mart_02_product_demand", DEMAND, "SELECT * FROM m_demand")
def _(x):
    return x.mart("product_demand")


@query("mart_03_campaign_response", CAMPAIGN, "SELECT * FROM m_campaign")
def _(x):
    return x.mart("campaign_response")


@query("mart_04_returns_risk", RETURNS, "SELECT * FROM m_returns")
def _(x):
    return x.mart("returns_risk")


@query("mart_05_recommendation_interactions", INTERACTIONS, "SELECT * FROM m_inter")
def _(x):
    return x.mart("recommendation_interactions")


@query("mart_06_store_week_performance", STORE, "SELECT * FROM m_store")
def _(x):
    return x.mart("store_week_performance")
