"""The queries op1 to op13 and the pipeline, each over its whole table."""

from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_trie, decontaminate, exact_dedup, jaccard_join, language, line_dedup, lm_score, mixing, parse_fingerprint, preferences, spelling, substring_dedup, token_counts
from .base import table

MAX_TOKENS = 2048


def _tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer_file())
    return counts.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preferences.conversations_as_rows(table(spark, sf_dir, "conversations"))
    found = preferences.preference_rows(preferences.pair_with_other_reply(rows))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["length"].cast("string"))), ",")
    return found.select(
        F.col("chosen_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected",
        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), texts=False)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify_languages(docs, language.fit_languages(docs))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = lm_score.good_documents(table(spark, sf_dir, "labels"))
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), drop_one_in=199)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if top not in sys.path:
        sys.path.insert(0, top)
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1,
        "op2_preference_pairs": op2,
        "op3_line_dedup": op3,
        "op4_source_mix": op4,
        "op5_language_id": op5,
        "op6_substring_dedup": op6,
        "op7_exact_dedup": op7,
        "op8_lm_score": op8,
        "op9_decontamination": op9,
        "op10_jaccard_join": op10,
        "op11_document_fingerprints": op11,
        "op12_conversation_trie": op12,
        "op13_spelling_variants": op13,
        "pipeline": pipeline,
    }


_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(" + _AZ + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP2_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
reply as (select t.conv_id, t.turn as last_turn, t.text as reply from t
  join (select conv_id, max(turn) as last_turn from t where role = 'assistant' group by conv_id) l on t.conv_id = l.conv_id and t.turn = l.last_turn),
paired as (select conv_id, last_turn, reply, coalesce(lead(reply) over w, first_value(reply) over w) as other
  from reply window w as (partition by conv_id // 64 order by conv_id)),
both_sides as (select t.conv_id, t.turn, t.role, t.text, case when t.turn = last_turn then other else t.text end as other_text,
    reply <> other and t.turn >= last_turn as completion from t join paired p on t.conv_id = p.conv_id),
placed as (select *,
    coalesce(sum(length(role) + length(text) + 6) over w, 0) + length(role) + 5 as start_a,
    coalesce(sum(length(role) + length(other_text) + 6) over w, 0) + length(role) + 5 as start_b
  from both_sides window w as (partition by conv_id, completion order by turn rows between unbounded preceding and 1 preceding))
select conv_id, cast(count(*) filter (where not completion) as int) as prompt_turns,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn) filter (where not completion), '') as prompt,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' order by turn) filter (where completion), '') as chosen,
  coalesce(string_agg('<|' || role || '|>' || chr(10) || other_text || chr(10), '' order by turn) filter (where completion), '') as rejected,
  coalesce(string_agg(cast(start_a as int) || ':' || length(text), ',' order by turn) filter (where completion and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(cast(start_b as int) || ':' || length(other_text), ',' order by turn) filter (where completion and role = 'assistant'), '') as rejected_mask
from placed group by conv_id
"""

OP3_SQL = rf"""
with line as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as nr from documents),
keyed as (select *, {_AZ.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from line),
common as (select key, max(doc_id) as keep from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (select k.doc_id, k.line, k.nr, c.key is not null and k.doc_id <> c.keep as dropped from keyed k left join common c on k.key = c.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by nr) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""

OP7_SQL = f"""
with n as (select doc_id, {_AZ.format("coalesce(text, '')")} as norm from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = max(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256 from n
"""

OP9_SQL = rf"""
with item as (select cast(item_id as varchar) as item, {_WORDS.format("text")} as words from benchmark),
sized as (select item, words, least(len(words), 10) as n from item where len(words) > 0),
gram as (select distinct item, n, array_to_string(words[i:i + n - 1], ' ') as gram from (select item, words, n, unnest(range(1, len(words) - n + 2)) as i from sized)),
doc as (select doc_id, coalesce({_WORDS.format("text")}, []) as words from documents),
spot as (select doc_id, s.n, unnest(range(1, len(words) - s.n + 2)) as i, words from doc, (select distinct n from gram) s where len(words) >= s.n),
hit as (select spot.doc_id, spot.i, spot.n, gram.item from spot join gram on gram.n = spot.n and gram.gram = array_to_string(spot.words[spot.i:spot.i + spot.n - 1], ' ')),
place as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hit group by doc_id)
select d.doc_id, cast(len(d.words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc d left join place using (doc_id) left join items using (doc_id)
"""


# the bits of CRC-32, eight for each byte of a list
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, {}),
    lambda acc, x: list_reduce(list_prepend(xor(acc, x), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::bigint)"""
_DIGITS = "list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)"
_BYTES = "list_transform(range(1, length(code) + 1, 2), lambda i: ('0x' || substr(code, i, 2))::bigint)"

OP12_SQL = f"""
with t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first) as p, coalesce(role, '') as r, coalesce(text, '') as x
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as b, {_CRC.format(_DIGITS)} % 9 as h from (select distinct conv_id from t)),
m as (
  select c.conv_id, 0 as own, p, r, x from c join t on t.conv_id = c.b and t.p <= c.h
  union all select c.conv_id, 1, p, r, x from c join t on t.conv_id = c.conv_id and t.p > c.h),
seq as (select c.conv_id, coalesce(list(struct_pack(r := r, x := x) order by own, p) filter (where r is not null), []) as turns from c left join m on c.conv_id = m.conv_id group by 1),
prefix as (select conv_id, len(turns) as n, d, turns[1:d] as path from (select *, unnest(range(0, len(turns) + 1)) as d from seq)),
node as (
  select path, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = d), '') as ends
  from prefix group by path, d),
kids as (select path[1:d - 1] as path, count(*) as n from node where d > 0 group by 1),
worth as (
  select node.path, node.d, cast(kids.n is null as bigint) as leaf, case when d > 0 then (n_convs - 1) * strlen(node.path[d].x) else 0 end as saved
  from node left join kids on node.path = kids.path),
total as (select path[1:k] as path, sum(leaf) as n_leaves, sum(saved) as saved from (select *, unnest(range(0, d + 1)) as k from worth) group by 1)
select node.conv_id, node.d as depth, up.conv_id as parent_conv_id, node.n_convs, coalesce(kids.n, 0) as n_children,
  cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(node.ends) as ends_sha256
from node left join node up on node.d > 0 and up.path = node.path[1:node.d - 1]
  left join kids on kids.path = node.path join total on total.path = node.path
"""


OP13_SQL = f"""
with recursive run as (
  select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all({_AZ.format("text")}, '[a-zÀ-ÿ]{{6,}}')) as run from documents),
one as (select doc, run, count(*) as k, hex(encode(doc || ':' || run)) as code from run group by 1, 2),
told as (select *, {_CRC.format(_BYTES)} as h from one),
word as (
  select case when h % 199 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, cast(sum(k) as bigint) as n
  from told group by 1 having length(word) >= 6 and sum(k) >= 5),
cut as (select word, length(word) as len, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as i from word)),
pair as (
  select a.word as a, b.word as b from cut a join cut b on a.len = b.len and a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select cut.word, word.word from cut join word on word.word = cut.rest
  union select word.word, cut.word from cut join word on word.word = cut.rest),
near as (select a as word, count(*) as n_near, arg_min(b, (-w.n, b)) as best, max(w.n) as best_n from pair join word w on w.word = b group by 1),
form as (select word.word, n, coalesce(n_near, 0) as n_near, case when best_n >= 5 * n then best end as form, case when best_n >= 5 * n then best_n end as form_n from word left join near using (word)),
path as (select word, word as goal, 0 as step from form union all select path.word, f.form, step + 1 from path join form f on f.word = path.goal where f.form is not null),
root as (select word, arg_max(goal, step) as root from path group by 1)
select word, form, root, n, n_near, form_n from form join root using (word)
"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express; the tests hold the others against brute force."""
    return {
        "op2_preference_pairs": OP2_SQL, "op3_line_dedup": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op9_decontamination": OP9_SQL,
        "op12_conversation_trie": OP12_SQL, "op13_spelling_variants": OP13_SQL,
    }
