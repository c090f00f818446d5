"""Declared schemas of the input and result tables."""

ITEMS = """
    item_id string, author_id string, create_time timestamp, create_date date, duration double, ratio string,
    desc string, desc_language string, is_english boolean, sticker_text string, transcript string,
    gpt_summary string, hashtags array<struct<hashtag_name:string>>, topic string,
    created_by_ai boolean, is_ads boolean, music_id string, music_title string, music_author string,
    word_count double, emoji_count double, question_count double, hashtag_count double, speaking_rate double,
    anger double, joy double, surprise double, sadness double, disgust double, fear double
"""

PANEL = """
    item_id string, days_since_post int, play_count double, like_count double, comment_count double,
    share_count double, collect_count double
"""

AUTHOR_STATE = "author_id string, date timestamp, follower_count double"

VECTORS = "item_id string, modality string, v array<float>"

SNAPSHOTS = """
    item_id string, author string, ts timestamp, upload_date string, added_at timestamp,
    views double, likes double, comments double
"""

BASELINES = "author string, median_views double, n bigint, updated_at timestamp"

JUDGE = """
    item_id string, hook string, clarity string, trend_fit string, arousal string, saturation string, cta string
"""

RUN_LOG = """
    label string, model string, target string, stage string, n_features bigint, protocol string,
    n bigint, roc_auc double, auc_lo double, auc_hi double, avg_precision double, brier double, seconds double
"""
