"""The tables of the library; nothing is inferred."""

SUBSCRIPTIONS = "feed_id string, feed_url string, title string, source_link string, subscribed_at timestamp"
FEED_DOCS = "feed_id string, fetched_at timestamp, xml string"
EPISODES = "feed_id string, episode_id string, guid string, title string, description string, pub_date timestamp, duration_s int, enclosure_url string"
STATE = "feed_id string, episode_id string, zone string, checked boolean, line_no int, title string, summary string"
SEGMENTS = "feed_id string, episode_id string, seg_no int, start_ms long, end_ms long, text string"
TRANSCRIPTS = "feed_id string, episode_id string, text string, n_chars long"
CHUNKS = "feed_id string, episode_id string, chunk_no int, text string, n_tokens long"
CHUNK_RESULTS = "feed_id string, episode_id string, chunk_no int, attempt int, status string, summary string"
TEMPLATES = "template_id string, style string, description string, required_sections array<string>, body string"
NOTES = "feed_id string, episode_id string, template_id string, mode string, markdown string"

#: What names an episode; never null.
KEY = ["feed_id", "episode_id"]
