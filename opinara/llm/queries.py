"""The operators of this folder as queries over the whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of its lines and of those that match an earlier line, and which."""
    from pyspark.sql import functions as F

    from .linededup import removed_lines

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
                          .cast("long").alias("n_lines"))
    return (counted.join(removed_lines(docs), "doc_id", "left")
            .select("doc_id", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
                    F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
                    F.coalesce(F.array_join("lines", ","), F.lit("")).alias("removed")))


@query("op1_media_columns")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text stored as a PNG and read back, and the picture's cosine hash in hex."""
    from pyspark.sql import functions as F

    from .media import encode_images, read_images

    read = read_images(encode_images(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return read.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"),
                       F.sha2("payload", 256).alias("payload_sha256"),
                       F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
                       F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
                       F.lower(F.hex("hash")).alias("feature"), "width", "height", "intact")


def tokenizer_path() -> str:
    """The vocabulary file that the query uses; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's ids and of the text that they decode to."""
    from pyspark.sql import functions as F

    from .sentencepiece_bpe import decode, encode

    model = tokenizer_path()
    both = decode(encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model), model)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by a model of ``labels.quality``."""
    from pyspark.sql import functions as F

    from .common import held_out
    from .quality import fit, score

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                         F.col("quality_score").alias("score"), F.col("accepted").cast("int").alias("predicted"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document by a model of ``labels.toxic``."""
    from .toxicity import fit, severity

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return severity(docs, fit(docs, _table(spark, sf_dir, "labels")))


_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
          ("block", "net/fr/"))


def _op8_sql() -> str:
    from .urls import UNWANTED

    fits = "\n".join(f"WHEN (host = '{n.partition('/')[0]}' OR ends_with(host, '.{n.partition('/')[0]}')) "
                     f"AND starts_with(path, '/{n.partition('/')[2]}') THEN '{n}'"
                     for _, n in sorted(_RULES, key=lambda r: -len(r[1])))
    words = "|".join("[^A-Za-z0-9]".join(w) for w in UNWANTED)
    verdicts = " ".join(f"WHEN '{n}' THEN '{v}'" for v, n in _RULES)
    return f"""
    WITH parted AS (
      SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT *, CASE {fits} END AS rule FROM parted)
    SELECT page_id, host, path, rule,
           CASE rule {verdicts} ELSE CASE WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9])({words})([^A-Za-z0-9]|$)')
                                          THEN 'block' ELSE 'allow' END END AS verdict
    FROM ruled"""


@query("op8_url_filters", _op8_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the host rules, else of the pattern rules, on every page."""
    from .urls import PATTERN_RULES, host_rule, judge

    rules = [*(host_rule(v, n) for v, n in _RULES), *PATTERN_RULES]
    return judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op9_embedding_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), 0.98)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 512 to 8,192 words."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans by kind, and all spans with those that the method adds."""
    from pyspark.sql import functions as F

    from .pii import KINDS, find, fit, joined

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    counts = [F.size(F.expr(f"filter(base_spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _op11_sql() -> str:
    """Trees of up to 16^5 leaves and sources, level by level."""
    field = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
    leaf = "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    bits = "list_reduce(list_concat([{0}], range(8)), lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = ("xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)), "
           "lambda a, b: " + bits.format("xor(a, b)") + "), 4294967295)")
    text = f"CASE WHEN {crc} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    ctes = [f"""docs AS (SELECT *, {leaf.format(text='text')} AS leaf, {leaf.format(text='changed')} AS claimed
                FROM (SELECT *, {text} AS changed FROM documents))""",
            """s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                      leaf AS digest, claimed AS fold, '' AS proof FROM docs)"""]

    def level(of: str, to: str, by: str, nodes: str, keep: str) -> None:
        """One level: runs of the distinct nodes, and each leaf's fold and proof."""
        part = f"PARTITION BY {by}" if by else ""
        match = f"r.{by} IS NOT DISTINCT FROM d.{by} AND" if by else ""
        group = f"{by}," if by else ""
        ctes.append(f"""{of}n AS (SELECT *, count(*) OVER ({part}) AS n FROM (SELECT DISTINCT {group} {nodes} FROM {of}))""")
        ctes.append(f"""{of}r AS (SELECT {group} pos // 16 AS run, any_value(n) AS n, list(digest ORDER BY pos) AS run_digests
                        FROM {of}n GROUP BY {group} pos // 16)""")
        beside = "array_to_string(run_digests[1:d.pos % 16], '')", "array_to_string(run_digests[d.pos % 16 + 2:], '')"
        ctes.append(f"""{to} AS (SELECT {keep}, CASE WHEN n = 1 THEN d.pos ELSE d.pos // 16 END AS pos,
            CASE WHEN n = 1 THEN digest ELSE sha256(array_to_string(run_digests, '')) END AS digest,
            CASE WHEN n = 1 THEN fold ELSE sha256({beside[0]} || fold || {beside[1]}) END AS fold,
            CASE WHEN n = 1 THEN proof ELSE proof || {beside[0]} || {beside[1]} END AS proof
            FROM {of} d JOIN {of}r r ON {match} d.pos // 16 = r.run)""")
    for i in range(5):
        level(f"s{i}", f"s{i + 1}", "source", "pos, digest", "d.doc_id, d.source, d.leaf")
    ctes.append("""t0 AS (SELECT doc_id, leaf, digest AS subroot, digest, fold, proof,
                          dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM s5)""")
    for i in range(5):
        level(f"t{i}", f"t{i + 1}", "", "pos, digest", "d.doc_id, d.leaf, d.subroot")
    return f"""WITH {", ".join(ctes)}
        SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
               fold = digest AS verified FROM t5"""


@query("op11_merkle_manifest", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, tested against a copy in which some texts were lower-cased."""
    from pyspark.sql import functions as F

    from .merkle import folded, manifest, proof_digest

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return (manifest(docs, tampered).withColumn("folded_root", folded("claimed"))
            .select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 4096


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, through a cache that begins empty."""
    from pyspark.sql import functions as F

    from opinara.session import scratch_path

    from .tokencache import token_counts

    counted = token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), scratch_path(spark, "token-cache"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation after a fixed damage."""
    import hashlib

    from pyspark.sql import functions as F

    from .repair import audit, damaged, repair, text_digests

    conversations = _table(spark, sf_dir, "conversations")
    reports, rows = repair(damaged(conversations))
    every = conversations.select("conv_id").distinct().withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(reports, "key", "left").join(text_digests(rows), "key", "left")
            .select("conv_id", *numbers, F.coalesce(audit(F.col("plan")), F.lit("")).alias("audit"),
                    F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256")))
