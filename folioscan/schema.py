"""Column contracts of the engine's relations."""

PAPER = (
    "arxiv_id string, title string, first_author string, authors array<string>, abstract string, primary_category string, categories array<string>, "
    "published string, updated string, pdf_url string, topics array<string>, tags array<string>, domain string"
)
#: A record of a shard file; keys that are not here are dropped.
RECORD = (
    "title string, abstract string, first_author string, authors array<string>, primary_category string, categories array<string>, pdf_url string, "
    "topics array<string>, published string, updated string, tags array<string>"
)
CHUNK = "arxiv_id string, section string, chunk_idx int, text string, n_chars int, n_tokens_est int"
SOURCE = "arxiv_id string, source string, markdown string, n_chars int, error string, images array<struct<name:string,url:string>>"
JOB_EVENT = "job_id string, seq long, kind string, state string, progress double, n_total int, n_done int, at timestamp, result string, error string, args string"
