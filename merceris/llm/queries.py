"""The thin queries over the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, gif, jaccard, manifest, neighbours, packing, quality, repeats, secret_scan, spelling, token_counts, url_filter, word_table
from .common import table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 200, digests=True)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find_secrets(docs, secret_scan.train(secret_scan.labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"), secret_scan.as_text(F.col("spans")).alias("spans"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scores.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


#: Rules of op8 as (verdict, host, path), and the host labels that its list blocks.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BLOCKED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key"))
    listed = hosts.where(F.arrays_overlap(F.split("key", r"\."), F.array(*map(F.lit, BLOCKED_LABELS))))
    return url_filter.filter_urls(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
with p as (select page_id, translate(regexp_extract(coalesce(url,''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
                  regexp_extract(coalesce(url,''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
r(v, h, s) as (values ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
m as (select page_id, host, path, (select max({'n': length(h)+length(s), 'rule': h||s, 'verdict': v}) from r where (host = h or ends_with(host, '.'||h)) and starts_with(path, s)) hit from p)
select page_id, host, path, hit.rule as rule,
       coalesce(hit.verdict, case when list_has_any(string_split(host,'.'), ['adult-x','ads-track','casino-win','cheap-pills','free-bets','spam-farm']) then 'block' else 'allow' end) verdict
from m
"""


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests=True)


def op10_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.gif_columns(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), least=7).where("n >= 2")
    return spelling.spelling_variants(words)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = manifest.merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], changed=tampered, values={"text": F.translate("text", UPPER, LOWER)})
    found = rows.withColumn("folded_root", manifest.folded(F.coalesce("offered", "leaf"), F.col("path")))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The CRC-32 of a list of bytes in DuckDB, by the usual table of 256 entries.
CRC_SQL = """
with recursive crc_table as materialized (select list_transform(range(256), lambda k: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, k)) t)
"""


def crc_sql(codes: str) -> str:
    """SQL for the CRC-32 of ``codes``, a list of bytes; needs CRC_SQL and ``crc_table`` among the tables."""
    return f"xor(4294967295, list_reduce({codes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint))"


OP11_SQL = rf"""{CRC_SQL},
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r from documents),
each as (select coalesce(doc_id::varchar, '') || ':' d, r, count(*) n from runs where length(r) >= 7 group by all),
hashed as (select r, n, {crc_sql("list_concat(list_transform(string_split(d, ''), lambda c: ord(c)::bigint), flatten(list_transform(string_split(r, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [195, ord(c)::bigint - 64] end)))")} h from each, crc_table),
results as (select case when h % 31 = 0 then substr(r, 1, (h % length(r))::bigint) || substr(r, (h % length(r))::bigint + 2) else r end word, n from hashed),
words as (select word, sum(n)::bigint n from results where length(word) >= 7 group by word having sum(n) >= 2),
holes as (select word, n, substr(word, 1, k - 1) b, substr(word, k + 1) e from (select word, n, unnest(range(1, length(word) + 1)) k from words)),
pairs as (select a.word w, b.word v, b.n from holes a join holes b on a.b = b.b and a.e = b.e and length(a.word) = length(b.word) and a.word <> b.word
          union select h.word, s.word, s.n from holes h join words s on s.word = h.b || h.e
          union select s.word, h.word, h.n from holes h join words s on s.word = h.b || h.e),
best as (select w, count(*) n_near, first(v order by n desc, encode(v)) v, max(n) n from pairs group by w),
forms as (select word, words.n, coalesce(n_near, 0)::bigint n_near, case when best.n >= 10 * words.n then v end form, case when best.n >= 10 * words.n then best.n end form_n from words left join best on w = word),
chain as (select word, form root, 1 k from forms where form is not null union all select c.word, f.form, c.k + 1 from chain c join forms f on f.word = c.root where f.form is not null),
ends as (select word, max_by(root, k) root from chain group by word)
select f.word, form, coalesce(root, f.word) root, n, n_near, form_n from forms f left join ends e on e.word = f.word
"""


OP12_SQL = rf"""{CRC_SQL},
l as (select *, {crc_sql("list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint)")} % 3 = 0 odd from documents, crc_table),
f as (select doc_id, lang, coalesce(odd, false) odd, list_transform([doc_id::varchar, source, lang, n_chars::varchar, text], lambda v: coalesce(octet_length(encode(v)) || ':' || v, '-')) v,
             coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') low from l),
leaves as (select doc_id, lang, odd, sha256(v[1]||v[2]||v[3]||v[4]||v[5]) leaf, sha256(v[1]||v[2]||v[3]||v[4]||low) offered from f),
ranked as (select *, dense_rank() over (order by encode(lang) nulls first) - 1 tree, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from leaves),
lv as (select tree, 0 lev, pos, n, leaf d from ranked union all
       select tree, lev + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' order by pos)) from lv where n > 1 group by tree, lev, pos // 8),
sub as (select tree, lev h, d from lv where n = 1),
tp as (select 0 lev, tree pos, (select count(*) from sub) n, d from sub union all
       select lev + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(d, '' order by pos)) from tp where n > 1 group by lev, pos // 8),
root as (select d root from tp where n = 1),
nodes as (select tree, lev, pos, d from lv where n > 1 union all select -1, 1000 + lev, pos, d from tp where n > 1),
sib as (select a.tree, a.lev, a.pos, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos < a.pos), '') lft, coalesce(string_agg(b.d, '' order by b.pos) filter (b.pos > a.pos), '') rgt
        from nodes a join nodes b on a.tree = b.tree and a.lev = b.lev and a.pos // 8 = b.pos // 8 group by all),
steps as (select r.doc_id, r.tree, r.pos own, s.lev, s.lft, s.rgt from ranked r join sib s on s.tree = r.tree and s.lev < 1000 and s.pos = r.pos >> (3 * s.lev)
          union all select r.doc_id, r.tree, r.pos, s.lev, s.lft, s.rgt from ranked r join sib s on s.tree = -1 and s.pos = r.tree >> (3 * (s.lev - 1000))),
stepped as (select *, row_number() over (partition by tree, own order by lev) k from steps),
fold as (select tree, pos own, 0::bigint k, case when odd then offered else leaf end d from ranked union all
         select f.tree, f.own, s.k, sha256(s.lft || f.d || s.rgt) from fold f join stepped s on s.tree = f.tree and s.own = f.own and s.k = f.k + 1),
proofs as (select tree, own, string_agg(lft || rgt, '' order by k) p from stepped group by all),
ends as (select tree, own, max_by(d, k) d from fold group by all)
select r.doc_id, r.leaf, sub.d subroot, root.root, sha256(coalesce(p.p, '')) proof_sha256, e.d folded_root, e.d = root.root verified
from ranked r join sub on sub.tree = r.tree cross join root join ends e on e.tree = r.tree and e.own = r.pos left join proofs p on p.tree = r.tree and p.own = r.pos
"""


def op13_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_table.bpe_by_words(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, digests=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_packing": op3_packing,
    "op4_secrets": op4_secrets,
    "op5_jaccard": op5_jaccard,
    "op6_token_counts": op6_token_counts,
    "op7_quality": op7_quality,
    "op8_url_filter": op8_url_filter,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_gif_columns": op10_gif_columns,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_bpe_words": op13_bpe_words,
}

ORACLES: dict[str, str] = {"op8_url_filter": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
