"""The queries of the numbered operators over whole `documents`, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_tree, bpe_lexicon, exact_dedup, gru_langid, lattice_lm, licences, minhash, packing, prefix_hash, prefix_trie, token_counts, token_files, url_filter
from .common import LOWER, UPPER


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(documents(spark, sf_dir))


def op3_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprint_documents(documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op5_gru_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_langid.identify(documents(spark, sf_dir))


def op6_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.encode_documents(documents(spark, sf_dir))


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(documents(spark, sf_dir))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filter.rules(spark))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 of the decimal digits of conv_id, bit by bit.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: list_transform(range(8), lambda b: (ascii(x) >> b) & 1)))), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_files, op2_lattice_lm, op3_prefix_hash, op4_token_counts, op5_gru_langid, op6_bpe_lexicon, op7_best_fit, op8_licences, op9_minhash, op10_exact_dedup, op11_ball_tree, op12_url_filter, op13_prefix_trie)
}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    t = f"regexp_replace(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), {quoted(licences.COPYRIGHT_SQL)}, '', 'g')"
    for a, b in licences.SPELLINGS:
        t = f"replace({t}, {quoted(a)}, {quoted(b)})"
    return f"trim(regexp_replace({t}, {quoted(licences.OTHER)}, ' ', 'g'), ' ')"


ORACLE_SQL: dict[str, str] = {
    "op8_licences": f"""
        with known as (select sha256({canonical_sql("t")}) digest, min(n) licence from (values {", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in licences.KNOWN.items())}) k(n, t) group by 1),
        forms as (select doc_id, {canonical_sql("text")} form from documents)
        select doc_id, sha256(form) canonical_sha256, length(form) n_canonical, licence from forms left join known on digest = sha256(form)""",
    "op9_minhash": rf"""
        with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') w from documents),
        shingles as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') s
                     from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from words where len(w) > 0)),
        sizes as (select doc_id, count(*) n from shingles group by 1),
        links as (select a, b from (select x.doc_id a, y.doc_id b, count(*) shared from shingles x join shingles y using (s) group by 1, 2)
                  join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared >= 75 * (p.n + q.n - shared)),
        reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
        least as (select a doc_id, min(b) component_id from reach group by 1)
        select doc_id, coalesce(n, 0) n_shingles, coalesce(component_id, doc_id) component_id, doc_id = coalesce(component_id, doc_id) kept
        from documents left join sizes using (doc_id) left join least using (doc_id)""",
    "op10_exact_dedup": f"""
        with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') norm from documents)
        select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(norm) text_sha256 from t window w as (partition by norm)""",
    "op11_ball_tree": rf"""
        with d as (select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ball_tree.TERM}') ws from documents where text is not null),
        docs as (select row_number() over () u, doc_id, ws, len(ws) n from d where len(ws) > 0),
        whole as (select count(*)::bigint big_n, sum(n)::bigint big_l from docs),
        items as (select row_number() over () q, item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{ball_tree.TERM}') ws from benchmark where text is not null),
        asked as (select q, t, count(*) c from (select q, unnest(ws) t from items) group by all),
        tf as (select u, doc_id, n, t, count(*)::bigint tf from (select u, doc_id, n, unnest(ws) t from docs) where t in (select t from asked) group by all),
        df as (select t, count(*)::bigint df from tf group by 1),
        parts as (select u, doc_id, tf.t, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))) s from tf join df using (t), whole),
        scores as (select q, u, doc_id, sum(c * s)::bigint score from asked join parts using (t) group by all having score > 0),
        best as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) r from scores)
        select item_id, r::int as rank, doc_id, score from best join items using (q) where r <= 20""",
    "op12_url_filter": f"""
        with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path from pages),
        rules(verdict, host, path, rule) as (values {", ".join(f"('{v}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{r}')" for v, r in url_filter.RULES)}),
        best as (select u.page_id, u.host, u.path, r.rule, r.verdict, row_number() over (partition by u.page_id, u.host, u.path order by length(r.rule) desc) k
                 from u left join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
        select page_id, host, path, rule, coalesce(verdict, '{url_filter.DEFAULT}') verdict from best where k = 1""",
    "op13_prefix_trie": f"""
        with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) i, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} x from conversations where conv_id is not null),
        own as (select conv_id, list(x order by i) xs from t group by 1),
        built as (select o.conv_id, list_concat(coalesce(b.xs[1 : h], []), o.xs[h + 1 :]) xs from (select *, {CRC32_SQL} % 9 h from own) o left join own b on b.conv_id = o.conv_id - o.conv_id % 5),
        paths as (select conv_id, d, xs[1 : d] k, len(xs) = d as ends from (select *, unnest(range(0, len(xs) + 1)) d from built)),
        nodes as (select k, d, min(conv_id) conv_id, count(*) n_convs, case when d = 0 then 0 else (count(*) - 1) * strlen(k[d].t) end own, string_agg(conv_id::varchar, ',' order by conv_id) filter (ends) ends from paths group by k, d),
        parents as (select k, conv_id from nodes),
        children as (select k[1 : d - 1] k, count(*) n from nodes where d > 0 group by 1),
        each as (select k, d, own, n is null leaf from nodes left join children using (k)),
        totals as (select up k, sum(leaf::bigint) n_leaves, sum(own) saved from (select leaf, own, k[1 : unnest(range(0, d + 1))] up from each) group by 1)
        select n.conv_id, n.d depth, p.conv_id parent_conv_id, n.n_convs, coalesce(c.n, 0) n_children, t.n_leaves::bigint n_leaves, t.saved::bigint saved_tokens, sha256(coalesce(n.ends, '')) ends_sha256
        from nodes n join totals t on t.k = n.k left join children c on c.k = n.k left join parents p on n.d > 0 and p.k = n.k[1 : n.d - 1]""",
}
