"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import format_conversations, read_back
from .decontaminate import COVERED, LITERALS, UNITS, WINDOW, decontamination
from .line_dedup import line_dedup
from .mixing import mix
from .near_dup import near_duplicates
from .quality import quality_classifier
from .shared import shared_dir
from .sharding import shard_index
from .substring_dedup import substring_dedup
from .token_store import read_tokens, write_tokens

WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, similarity 0.8."""
    return line_dedup(_table(spark, sf_dir, "documents")).drop("tag")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of marks, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return read_back(format_conversations(turns.union(hard)))


OP2_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(role) + length(text) + 14 + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '###', ''))) // 3 + (length(text) - length(replace(text, '</turn>', ''))) // 7 as n from t)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256, sum(n)::bigint formatted_chars
from e group by conv_id
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; keep is false for what the classifier rejects."""
    return quality_classifier(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "votes", "score", "keep")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _templates(table: str, key: str) -> str:
    base = rf"regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])[.,]([0-9])', '\1\2', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')), '([0-9])({UNITS})( |$)', '\1 \2\3', 'g')"
    form = rf"lower(regexp_replace(regexp_replace(regexp_replace(b, '([0-9]) ({UNITS})( |$)', '\1 <unit>\3', 'g'), '(^| )\p{{Lu}}[^ ]*', '\1<name>', 'g'), '(^| )[0-9][^ ]*', '\1<num>', 'g'))"
    return f"select {key} k, string_split(b, ' ') b, string_split({form}, ' ') s from (select {key}, {base} b from {table})"


OP4_SQL = f"""
with d as ({_templates("documents", "doc_id")}), i as ({_templates("benchmark", "item_id")}),
dw as (select k, p, s[p:p + {WINDOW - 1}] w, b[p:p + {WINDOW - 1}] v from (select *, unnest(range(1, len(s) - {WINDOW - 2})) p from d)),
iw as (select k, q, n, s[q:q + {WINDOW - 1}] w, b[q:q + {WINDOW - 1}] v from (select *, len(s) n, unnest(range(1, len(s) - {WINDOW - 2})) q from i) where len(list_filter(s[q:q + {WINDOW - 1}], lambda x: not starts_with(x, '<'))) >= {LITERALS}),
m as (select dw.k d, iw.k i, n, p - q g, q, unnest(range(1, {WINDOW + 1})) j, iw.w w, iw.v iv, dw.v dv from dw join iw on dw.w = iw.w),
t as (select distinct d, i, n, g, q + j place, w[j] slot, iv[j] iv, dv[j] dv from m),
s as (select d, i, n, g, case when starts_with(slot, '<') then slot || iv end held, count(*) c, case when starts_with(min(slot), '<') then min(dv) = max(dv) else true end same from t group by 1, 2, 3, 4, 5),
l as (select d, i, n, g, sum(c) c from s group by 1, 2, 3, 4 having bool_and(same)),
e as (select d, i, n, sum(c) c from l group by 1, 2, 3 having sum(c) >= greatest({WINDOW}, least({COVERED}, ceil(n / 2)))),
f as (select d, count(*) n_items, max(c) c from e group by 1)
select doc_id, f.d is not null contaminated, coalesce(n_items, 0)::bigint n_items, coalesce(c, 0)::bigint most_covered from documents left join f on doc_id = f.d
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, windows of 13 words."""
    return substring_dedup(_table(spark, sf_dir, "documents"), window=13, texts=False).withColumnRenamed("kept", "kept_sha256")


OP5_SQL = f"""
with w as (select doc_id, {WORDS.format(text="text")} w from documents),
g as (select doc_id, unnest(range(1, len(w) - 11)) i, w from w),
h as (select doc_id, i, array_to_string(w[i:i + 12], ' ') h from g),
f as (select h, min(doc_id) f from h group by 1),
r as (select doc_id, list_distinct(flatten(list(range(i, i + 13)))) r from h join f using (h) where f < doc_id group by 1),
k as (select w.doc_id, len(w) n, coalesce(len(r), 0) m, case when r is null then w else list_filter(list_transform(range(1, len(w) + 1), lambda j: case when not list_contains(r, j) then w[j] end), lambda x: x is not null) end k from w left join r using (doc_id))
select doc_id, n n_words, m::bigint n_removed, sha256(array_to_string(k, ' ')) kept_sha256 from k
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; sources weigh 3, 1, 2 by turns and share 150 percent of all words, twice their own at most."""
    return mix(_table(spark, sf_dir, "documents")).drop("source")


OP6_SQL = f"""
with d as (select doc_id, source, len({WORDS.format(text="text")})::bigint size, md5(doc_id::varchar) k from documents),
s as (select source, sum(size)::bigint source_size from d group by 1),
p as (select *, row_number() over (order by source is null, encode(source)) - 1 place from s),
w as (select *, case place % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end weight, 2.0::double * source_size cap from p),
l as (select *, sum(source_size) over () as all_words, coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0) before, sum(weight) over (order by cap / weight, place rows between current row and unbounded following) rest from w),
v as (select *, (1.5::double * all_words - before) / rest as level from l),
m as (select max(level) filter (where level * weight < cap) level from v),
t as (select v.source, v.source_size, v.place, case when m.level is null or m.level * v.weight >= v.cap then v.cap else m.level * v.weight end target from v, m),
o as (select d.*, t.source_size, t.place, t.target, (sum(size) over (partition by d.source order by k, doc_id rows between unbounded preceding and current row) - size)::bigint ofs from d join t on d.source is not distinct from t.source),
q as (select *, greatest(0, least(size, floor(target)::bigint - ofs)) + greatest(0, least(size, floor(target)::bigint - ofs - source_size)) taken from o),
z as (select *, ofs / target x from q)
select doc_id, size, source_size, target, taken::bigint taken, case when taken > 0 then least(1.0, case place % 3
  when 0 then x
  when 1 then 2 * x / (0.5 + sqrt(0.25 + 2 * x))
  else case when x <= 0.625 then 2 * x / (1.5 + sqrt(greatest(0, 2.25 - 2 * x))) else 0.5 + 2 * (x - 0.625) / (1 + sqrt(greatest(0, 1 - 2 * (x - 0.625)))) end end) end as position
from z
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, by the law of equal row counts; the rows themselves are written to the shards and read back."""
    return shard_index(_table(spark, sf_dir, "documents"), shards=16)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the byte-level tokenizer, written to token files and read from them again."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids=False)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, two-word shingles, 80 percent."""
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


OP8_SQL = f"""
with recursive w as (select doc_id, {WORDS.format(text=LOWERED)} w from documents),
s as (select doc_id, unnest(case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) when len(w) = 1 then w else [] end) s from w),
n as (select doc_id, count(*) n from s group by 1),
classes as (select doc_id, n, min(doc_id) over (partition by c) first from (select doc_id, count(*) n, string_agg(s, chr(10) order by s) c from s group by 1)),
r as (select s.* from s join classes using (doc_id) where doc_id = first),
i as (select a.doc_id a, b.doc_id b, count(*) c from r a join r b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
both_ways as (select a, b from e union all select b, a from e union all select doc_id, first from classes union all select first, doc_id from classes),
reach as (select doc_id, doc_id c from documents union select b.a, r.c from reach r join both_ways b on b.b = r.doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, min(r.c) component_id, d.doc_id = min(r.c) kept
from documents d left join n using (doc_id) left join reach r using (doc_id) group by d.doc_id, n.n
"""

def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all vectors."""
    return nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_line_dedup": op1_line_dedup, "op2_chat": op2_chat, "op3_quality": op3_quality, "op4_decontaminate": op4_decontaminate, "op5_substring_dedup": op5_substring_dedup, "op6_mixing": op6_mixing, "op7_token_store": op7_token_store, "op8_near_dup": op8_near_dup, "op9_ann": op9_ann, "op10_sharding": op10_sharding}
ORACLES: dict[str, str] = {"op2_chat": OP2_SQL, "op4_decontaminate": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op6_mixing": OP6_SQL, "op8_near_dup": OP8_SQL}
