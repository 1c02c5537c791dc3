"""Explicit schemas of the engine's tables.  Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TABLES: dict[str, str] = {}


def __getattr__(name: str) -> T.StructType:
    """Tables by name; DDL is parsed by the running session, hence on first use."""
    if name in _TABLES:
        return T.StructType.fromDDL(_TABLES[name])
    raise AttributeError(name)


METADATA = "struct<score:double,num_comments:bigint,upvote_ratio:double,points:bigint,author:string>"

_TABLES["RAW_RECORD"] = (
    "source string, source_type string, title string, text string, url string, "
    f"ts timestamp, metadata {METADATA}, ingest_seq bigint")

_TABLES["CANONICAL"] = (
    "source string, source_tier int, title string, text string, url string, "
    "ts timestamp, raw_engagement bigint, ingest_seq bigint")

_TABLES["ITEM"] = (
    "external_id string, source string, source_type string, subject string, title string, "
    "text string, author string, url string, ts timestamp, score int, rationale string, "
    "embedding array<float>, created_at timestamp, ingest_seq bigint")

CITATION = "struct<n:int,source:string,url:string,score:int,quote:string>"
BACKTEST = (
    "struct<period:string,n_periods:int,proxy:string,lead_r:double,coincident_r:double,"
    "lag_r:double,n_pairs:map<string,int>,note:string,"
    "series:array<struct<period:string,conviction:double,price:double,`return`:double>>>")

_TABLES["READING"] = (
    "subject string, computed_at timestamp, label string, consensus_score double, "
    "conviction double, dispersion double, volume bigint, proxy string, is_financial boolean, "
    f"display string, asset_type string, report_md string, citations array<{CITATION}>, "
    f"backtest {BACKTEST}")

_TABLES["LEDGER"] = (
    "guid string, show string, title string, published timestamp, processed_at timestamp, "
    "status string, detail string, n_passages int, n_items int")

_TABLES["DAILY"] = (
    "run_date date, consensus_score double, label string, confidence string, contested boolean, "
    "dispersion double, item_count bigint, contributing_count bigint, tier_means map<int,double>, "
    "tickers array<struct<ticker:string,score:double,label:string,mentions:bigint,confidence:string>>, "
    "top_themes array<struct<theme:string,n:bigint>>, bull_signals array<string>, "
    "bear_signals array<string>")

_TABLES["EPISODE"] = (
    "guid string, show string, show_idx int, feed_idx int, title string, published timestamp, "
    "audio_url string, transcript_url string, description string")

_TABLES["SEGMENT"] = (
    "guid string, seg_idx int, start double, end double, speaker string, text string")

_TABLES["SUBJECT_DIM"] = (
    "input_key string, display string, asset_type string, is_financial boolean, proxy string, "
    "hn_query string, reddit_query string, subreddits array<string>, aliases array<string>, "
    "input string, seq bigint")

_TABLES["REQUEST_LOG"] = ("client string, ts timestamp")

_TABLES["RESPONSE"] = ("custom_id string, body string, error_class string")

SUBJECT_JSON = (
    "map<string,struct<display:string,asset_type:string,is_financial:boolean,proxy:string,"
    "hn_query:string,reddit_query:string,subreddits:array<string>,aliases:array<string>,"
    "input:string>>")
