"""Schemas of the tables that the operators exchange, as DDL."""

POSTS = "post_id long, date timestamp, text string, channel string"
FEATURES = "char_len int, n_paragraphs int, has_emoji boolean, ends_with_question boolean, source_text_hash string, group_id string"
RECORD = (
    "post_id long, date string, split string, style_type string, channel string, instruction string, input string, input_source string, "
    "input_heuristic string, response_raw string, response_clean string, group_id string, source_text_hash string, split_strategy string, "
    "char_len int, n_paragraphs int, has_emoji boolean, ends_with_question boolean, prompt string"
)
OVERRIDE = "post_id long, style_type string, neutral string, synthetic_input string, input string, failed boolean, synthetic_ok boolean, jaccard double, prompt_mode string"
USAGE = "usage_prompt_tokens long, usage_completion_tokens long, usage_total_tokens long, cost_usd_estimate double"
ATTEMPT = "attempt int, model string, failed boolean, failure_reason string, content string, " + USAGE
MANIFEST = (
    "pilot_id string, post_id long, group_id string, style_type string, split string, source_split string, source_file string, date string, response_clean string, "
    "char_len int, n_paragraphs int, has_emoji boolean, has_numbers boolean, char_len_q string, multi_para boolean, stratum string, manifest_seed int, manifest_created_at string"
)
