"""Registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, language_id, license_scan, line_dedup, lm_score, packing, phrases, prefix_trie, quality_rules, sentence_pieces, simhash, toxicity
from .common import fold, table

TOKENIZER, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = language_id.learn(docs.where(fold(4) != 2))
    return language_id.identify(docs, network).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("text").isNull(), 0).otherwise(lines).alias("n_lines"))
    return line_dedup.without_repeats(docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.scored(table(spark, sf_dir, "documents"), lm_score.contract_training())
    return found.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    return toxicity.judged(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.grafted(prefix_trie.sequences(table(spark, sf_dir, "conversations")))
    return prefix_trie.nodes(turns)


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') t,
    [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] ws,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] ls
  from documents),
grams as (
  select doc_id, i, count(*) over (partition by doc_id, g) times
  from (select doc_id, i, array_to_string(ws[i:i + 7], ' ') g from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from d))),
repeats as (
  select doc_id, count(distinct p) n_repeat_words
  from (select doc_id, unnest(range(i, i + 8)) p from grams where times > 1) group by 1),
f as (
  select doc_id, t, ws, ls, len(ws) n_words, coalesce(list_sum([length(x) for x in ws]), 0) word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols,
    len(ls) - list_unique(ls) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) capitals,
    length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) ascii_letters,
    strlen(t) - strlen(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) other_bytes,
    strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) dark_bytes,
    len([x for x in ws if regexp_full_match(x, '[!-/:-@\[-`{-~]+')]) loose,
    len([i for i in range(2, len(ws) + 1) if ws[i] = ws[i - 1]]) stutters
  from d left join repeats using (doc_id)),
j as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from f)
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols,
  cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words, base_failed,
  not base_failed and not (4 * n_symbols > n_words) and not (10 * capitals > 7 * greatest(20, ascii_letters))
    and not (5 * (ascii_letters + other_bytes) < 2 * dark_bytes) and not (5 * loose > n_words)
    and not (10 * stutters > 3 * n_words) and word_chars between 2 * n_words and 14 * n_words and not (2 * n_dup_lines > len(ls)) kept
from j
"""

OP6_SQL = r"""
with lines as (
  select doc_id, line, pos, array_to_string([x for x in regexp_split_to_array(line, '[\x20\x09-\x0D]+') if x <> ''], ' ') norm
  from (select doc_id, unnest(ls) line, unnest(range(len(ls))) pos from (select doc_id, string_split(text, chr(10)) ls from documents))),
full_lines as (
  select doc_id, pos, norm, row_number() over w k, sum(n) over w total, n
  from (select *, len(string_split(norm, ' ')) n from lines where norm <> '') window w as (partition by doc_id order by pos)),
windows as (
  select a.doc_id, a.pos first_pos, b.pos last_pos, a.k k1, b.k k2
  from full_lines a join full_lines b on a.doc_id = b.doc_id and b.total >= a.total - a.n + 50 and (b.total - b.n < a.total - a.n + 50 or a.total > b.total - 50)),
keyed as (
  select w.doc_id, first_pos, last_pos, string_agg(c.norm, chr(10) order by c.k) content
  from windows w join full_lines c on c.doc_id = w.doc_id and c.k between k1 and k2 group by 1, 2, 3),
ranked as (select *, row_number() over (partition by content order by doc_id, first_pos) seen from keyed),
gone as (select distinct l.doc_id, l.pos from lines l join ranked r on r.doc_id = l.doc_id and r.seen > 1 and l.pos between first_pos and last_pos)
select l.doc_id, cast(count(*) as bigint) n_lines, cast(count(g.pos) as bigint) n_removed,
  coalesce(string_agg(l.line, chr(10) order by l.pos) filter (where g.pos is null), '') as text
from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id
"""

OP7_SQL = r"""
with dw as (select doc_id, [x for x in regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] ws from documents),
iw as (select item_id, [x for x in regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] ws from benchmark),
kinds as (select distinct least(len(ws), 5) k from iw where len(ws) > 0),
ds as (select distinct doc_id, array_to_string(ws[i:i + k - 1], ' ') g from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) i from dw, kinds)),
its as (select distinct item_id, array_to_string(ws[i:i + k - 1], ' ') g from (select item_id, ws, k, unnest(range(1, len(ws) - k + 2)) i from (select *, least(len(ws), 5) k from iw where len(ws) > 0))),
n as (select item_id, count(*) n_shingles from its group by 1),
hits as (select doc_id, item_id, count(*) n_found from ds join its using (g) group by 1, 2)
select doc_id, item_id, n_shingles, n_found, n_found / n_shingles::double containment
from hits join n using (item_id) where n_found >= ceil(0.8 * n_shingles - 1e-9)
"""

OP11_SQL = r"""
with recursive bits as (select i, 0 k, cast(i as bigint) v from range(256) t(i)
  union all select i, k + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from bits where k < 8),
crc as (select list(v order by i) t from bits where k = 8),
ids as (select distinct conv_id, conv_id - conv_id % 100 base, cast(conv_id as varchar) name from conversations where conv_id is not null),
crcs as (
  select conv_id, base, name, 1 pos, cast(4294967295 as bigint) v from ids
  union all select conv_id, base, name, pos + 1, xor(v >> 8, t[1 + (xor(v, ascii(substr(name, pos, 1))) & 255)]) from crcs, crc where pos <= length(name)),
heads as (select conv_id, base, xor(v, 4294967295) % 6 h from crcs where pos > length(name)),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) k,
    md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) key, length(coalesce(text, '')) chars
  from conversations where conv_id is not null),
built as (
  select h.conv_id, t.k, t.key, t.chars from heads h join turns t on t.conv_id = h.base and t.k <= h.h
  union all select h.conv_id, t.k + 1000000000, t.key, t.chars from heads h join turns t on t.conv_id = h.conv_id and t.k > h.h),
seqs as (select i.conv_id, coalesce(list(b.key order by b.k) filter (where b.k is not null), []) keys, coalesce(list(b.chars order by b.k) filter (where b.k is not null), []) sizes
  from ids i left join built b on b.conv_id = i.conv_id group by 1),
members as (select conv_id, unnest(range(len(keys) + 1)) depth, keys, sizes from seqs),
n as (
  select keys[1:depth] path, depth, min(conv_id) conv_id, count(*) n_convs, coalesce(any_value(sizes[depth]), 0) chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(keys) = depth), '')) ends_sha256
  from members group by 1, 2),
kids as (select path[1:depth - 1] path, depth - 1 depth, count(*) n_children from n where depth > 0 group by 1, 2),
own as (select n.*, coalesce(n_children, 0) n_children from n left join kids using (path, depth)),
above as (select path[1:d] path, d depth, case when n_children = 0 then 1 else 0 end leaf, (n_convs - 1) * chars saved from (select *, unnest(range(depth + 1)) d from own)),
sums as (select path, depth, sum(leaf) n_leaves, sum(saved) saved_tokens from above group by 1, 2)
select o.conv_id, cast(o.depth as bigint) depth, p.conv_id parent_conv_id, cast(o.n_convs as bigint) n_convs, cast(o.n_children as bigint) n_children,
  cast(s.n_leaves as bigint) n_leaves, cast(s.saved_tokens as bigint) saved_tokens, o.ends_sha256
from own o join sums s on s.path = o.path and s.depth = o.depth left join own p on p.depth = o.depth - 1 and p.path = o.path[1:o.depth - 1]
"""

OP13_SQL = r"""
with pieces as (select coalesce(lang, 'und') lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
words as (select lang, [x for x in regexp_split_to_array(piece, '[\x20\x09]+') if x <> ''] ws from pieces),
grams as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from words, range(1, 4) t(k))),
f as (select lang, k, phrase, count(*) f from grams group by 1, 2, 3),
n as (select lang, sum(f) n from f where k = 1 group by 1),
cand as (select lang, k, phrase, string_split(phrase, ' ') ws, f a from f where k > 1 and f >= 10),
cuts as (select lang, k, phrase, a, c, array_to_string(ws[1:c], ' ') p, array_to_string(ws[c + 1:], ' ') q from (select *, unnest(range(1, k)) c from cand)),
scored as (
  select u.lang, u.k, u.phrase, u.a, c, x.f l, y.f r, cast(1000000::hugeint * u.a * u.a // (x.f::hugeint * y.f) as bigint) score
  from cuts u join f x on x.lang = u.lang and x.phrase = u.p join f y on y.lang = u.lang and y.phrase = u.q),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_pairs as (select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) phrase, a from cand where k = 3),
longer as (select lang, phrase, max(a) longer from inner_pairs group by 1, 2),
kept as (select s.* from lowest s left join longer g using (lang, phrase) where not coalesce(100 * longer >= 50 * a, false)),
best as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from kept qualify rank <= 2000)
select lang, rank, phrase, a, l, r, cast(n as bigint) n, score from best join n using (lang)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_html_text, op3_quality_rules, op4_license_scan, op5_simhash, op6_line_dedup, op7_decontaminate, op8_packing, op9_lm_score, op10_toxicity, op11_prefix_trie, op12_sentence_pieces, op13_phrases)
}
ORACLE_SQL = {"op3_quality_rules": OP3_SQL, "op6_line_dedup": OP6_SQL, "op7_decontaminate": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op13_phrases": OP13_SQL}
