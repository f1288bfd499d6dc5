"""One query for each operator, over its whole table, and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm.clustering import cluster_vectors
from gridweave.llm.decontamination import contaminated
from gridweave.llm.fingerprints import edited_fingerprints
from gridweave.llm.html_text import extract_text
from gridweave.llm.lexical_search import search
from gridweave.llm.line_dedup import line_dedup
from gridweave.llm.mixing import fit_domains, mix_sources
from gridweave.llm.ngram_join import ngram_join
from gridweave.llm.quality_rules import quality_rules
from gridweave.llm.token_files import token_files
from gridweave.llm.tokens import public_path, token_counts
from gridweave.llm.toxicity import fit_toxicity, toxicity
from gridweave.llm.warc import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of the language domains in the mixture.
MIXTURE = {"en": 0.5, "fr": 0.2, "de": 0.15, "es": 0.15}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return mix_sources(docs, fit_domains(docs, labelled, tuple(MIXTURE)), MIXTURE)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=2)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("k1", "k2", "class_key")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), limit=512)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    # Which rule was first depends on measured costs, so it stays with the operator.
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def _lloyd_sql(rounds: int) -> str:
    """Each round over distinct vectors: the nearest centroid by least 16 * distance + number, then the floors of means."""
    nearest = """a{0} as (
  select q, n, min(16 * list_sum(list_transform(range(1, 65), lambda i: (d.q[i] - c.p[i]) * (d.q[i] - c.p[i])))::hugeint + c.c) v from d cross join c{0} c group by q, n
)"""
    moved = """c{1} as (
  select c.c, coalesce(m.p, c.p) p from c{0} c left join (
    select c, list(((s - ((s % w) + w) % w) // w)::bigint order by i) p from (
      select v % 16 c, i, sum(n * q[i])::hugeint s, sum(n)::hugeint w from a{0}, range(1, 65) t(i) group by all
    ) group by c
  ) m on m.c = c.c
)"""
    steps = [part.format(r, r + 1) for r in range(rounds) for part in (nearest, moved)] + [nearest.format(rounds)]
    return """
with kept as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64
), d as (
  select q, count(*) n from kept group by q
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id), q) - 1 c, q p from kept qualify c < 16
), {0}
select vec_id, (v % 16)::int "cluster", (v // 16)::bigint distance, sum(v // 16) over (partition by v % 16)::bigint cluster_inertia,
  sum(v // 16) over ()::bigint inertia, sha256(array_to_string(p, ',')) centroid_sha256
from kept join a{1} using (q) join c{1} c on c.c = v % 16
""".format(", ".join(steps), rounds)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_html_text": op7_html_text,
    "op8_ngram_join": op8_ngram_join,
    "op9_token_counts": op9_token_counts,
    "op10_quality_rules": op10_quality_rules,
    "op11_clusters": op11_clusters,
    "op12_search": op12_search,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL = {
    "op12_search": r"""
with t as (
  select doc_id, row_number() over () r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from documents
), s as (
  select count(*) filter (len(ts) > 0) docs, sum(len(ts))::bigint terms from t
), p as (
  select r, doc_id, n, term, count(*) tf from (select r, doc_id, len(ts) n, unnest(ts) term from t) group by all
), w as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)))::bigint w from p, s group by term, docs
), q as (
  select item, item_id, term, count(*) qtf from (
    select row_number() over () item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from (select distinct item_id, text from benchmark)
  ) group by all
), scored as (
  select item, item_id, r, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint score
  from q join p using (term) join w using (term), s group by all
)
select item_id, (row_number() over (partition by item order by score desc, doc_id))::int "rank", doc_id, score from scored where score > 0
qualify "rank" <= 10
""",
    "op11_clusters": _lloyd_sql(3),
    # Base 32 is taken from the hexadecimal digits, five bits at a time.
    "op3_warc": """
with p as (
  select page_id, coalesce(html, '') body from pages
), d as (
  select page_id, strlen(body)::bigint payload_bytes, sha1(body) digits, min(page_id) over (partition by body) holder from p
)
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (instr('0123456789abcdef', substr(digits, 5 * k // 4 + 1, 1)) - 1)
    + instr('0123456789abcdef', substr(digits, 5 * k // 4 + 2, 1)) - 1)::int >> (3 - 5 * k % 4)::int) & 31), 1) for k in range(32)], '') payload_digest,
  case when page_id = holder then 'response' else 'revisit' end record_type, case when page_id <> holder then holder end refers_to
from d
""",
    # All pairs with an n-gram in common; classes by what is reached over links.
    "op8_ngram_join": """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from documents
), c as (
  select ws, min(doc_id) copy_id, count(*) copies from w where len(ws) > 0 group by ws
), g as (
  select distinct copy_id d, unnest(case when len(ws) < 5 then [array_to_string(ws, ' ')] else [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] end) gram from c
), n as (
  select d, count(*) n from g group by d
), pairs as (
  select x.d a, y.d b, count(*) both_have from g x join g y on x.gram = y.gram and x.d <> y.d group by all
), links as (
  select a, b from pairs join n na on na.d = a join n nb on nb.d = b where 5 * both_have >= 4 * (na.n + nb.n - both_have)
), reach as (
  select copy_id a, copy_id b from c union select r.a, l.b from reach r join links l on r.b = l.a
), class as (
  select a, min(b) class_id from reach group by a
), linked as (
  select a, sum(copies)::bigint n from links join c on b = copy_id group by a
)
select doc_id, coalesce(class_id, doc_id) class_id, (coalesce(linked.n, 0) + coalesce(copies, 1) - 1)::bigint n_links, coalesce(copy_id, doc_id) copy_id
from w left join c on w.ws = c.ws left join class on class.a = copy_id left join linked on linked.a = copy_id
""",
    "op2_line_dedup": """
with l as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) pos
  from documents
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l
), r as (
  select k, min(doc_id) keep from k where length(k) >= 10 group by k having count(distinct doc_id) >= 2
), m as (
  select k.*, r.k is not null and k.doc_id <> r.keep gone from k left join r on k.k = r.k
)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) kept_sha256
from m group by doc_id
""",
}
