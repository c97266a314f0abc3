"""The numbered queries: each operator over its whole table, with the settings of production."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyflow.llm import byte_bpe, decontaminate, jaccard, language_id, near_vectors, phrases, quality, reply_trees, secret_scan, token_files, toxicity, url_filter, whitening
from tallyflow.llm.common import QUERIES, ORACLES, query, table  # noqa: F401

RULES = [
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
]

_HOST = "coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


@query(
    "op8_url_filter",
    f"""
    with split as (
      select page_id, url, {_HOST} as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
      from pages),
    ruled as (
      select *, case
        when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
        when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
        when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
        when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
      from split)
    select page_id, host, path, rule, case
        when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
        when host in (select host from split where contains(url, 'utm_source=')) then 'block' else 'allow' end as verdict
    from ruled""",
)
def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Listed are the hosts that put a tracking parameter on any link of theirs."""
    pages = table(spark, sf, "pages").select("page_id", "url")
    listed = pages.where(F.contains("url", F.lit("utm_source="))).select(url_filter.host_of("url").alias("host")).distinct()
    return url_filter.judge_urls(pages, RULES, listed)


@query(
    "op10_reply_trees",
    r"""
    with turns as (
      select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r, text as t from conversations
      union all values (-7::bigint, 0::bigint, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'),
                       (-7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'))
    select conv_id, count(*) as n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r nulls first, t nulls first)) as turns_sha256,
      coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(text, '' order by turn nulls first, r nulls first, t nulls first) filter (role = 'assistant'), '')) as loss_sha256,
      sum(length('### : ' || ' </turn>' || chr(10)) + length(regexp_replace(role, '([\\#<:])', '\1\\', 'g'))
          + length(regexp_replace(text, '([\\#<])', '\1\\', 'g')))::bigint as formatted_chars
    from turns group by conv_id""",
)
def op10_reply_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation is a tree of one branch; what is returned is read back from the formatted text."""
    said = F.lit("\\### Assistant: </turn> ok").alias("text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said,
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    messages = reply_trees.messages_of_turns(rows)
    done = reply_trees.format_paths(messages, reply_trees.best_paths(messages))
    read = done.select(
        F.col("tree").alias("conv_id"), "formatted",
        reply_trees.read_turns("formatted").alias("turns"), reply_trees.read_loss("formatted", "loss_spans").alias("loss"),
    )
    newline = F.lit("\n")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), ""), 256
        ).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    folder = token_files.token_folder(docs)
    manifest = token_files.write_token_files(docs, folder, vocabulary, end_id=2)
    read = token_files.read_token_files(manifest, folder, vocabulary)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    done = byte_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_near_vectors")
def op9_near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), 0.9)


#: Shingle sets, links and their closure, without any index.
NEAR_SQL = r"""
    words as materialized (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
      from docs),
    sets as materialized (
      select doc_id, unnest(list_distinct(case when len(w) >= 5
          then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
          when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s
      from words),
    sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
    links as materialized (
      select p.a, p.b from (select x.doc_id as a, y.doc_id as b, count(*) as shared from sets x join sets y using (s)
                            where x.doc_id <> y.doc_id group by all) p
      join sizes na on na.doc_id = p.a join sizes nb on nb.doc_id = p.b where 100 * p.shared >= 80 * (na.n + nb.n - p.shared)),
    reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
    near as (
      select w.doc_id, coalesce(z.n, 0) as n_shingles,
             least(w.doc_id, coalesce((select min(b) from reach r where r.a = w.doc_id), w.doc_id)) as component_id
      from words w left join sizes z using (doc_id))"""


@query(
    "op4_ngram_jaccard",
    f"with recursive docs as (select doc_id, text from documents), {NEAR_SQL} select doc_id, n_shingles, component_id from near",
)
def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"))


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf, "benchmark").select("item_id", "text"))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf, "labels").select("doc_id", "toxic"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality.quality(docs, table(spark, sf, "labels").select("doc_id", "quality"))


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf, "documents").select("doc_id", "text", "source"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf: str) -> DataFrame:
    done = whitening.whitened(table(spark, sf, "embeddings").select("vec_id", "embedding"), 32)
    # A deviation that passes 64 bits is null here; the operator has it as a decimal.
    return done.withColumn("deviation", F.col("deviation").try_cast("bigint"))


@query("op12_language_id")
def op12_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id.languages(table(spark, sf, "documents").select("doc_id", "text", "lang"))


#: Every phrase and every cut spelt out, without a tree.
PHRASES_SQL = r"""
    with pieces as (
      select coalesce(lang, 'und') as lang, unnest(string_split_regex(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
      from documents),
    words as materialized (
      select lang, row_number() over () as piece, w from (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces) where len(w) > 0),
    totals as (select lang, sum(len(w))::bigint as n from words group by lang),
    grams as (
      select lang, w[i : i + k - 1] as p, k
      from (select lang, w, unnest(range(1, len(w) + 1)) as i from words), (select unnest(range(1, 6)) as k) where i + k - 1 <= len(w)),
    counts as materialized (
      select lang, array_to_string(p, ' ') as phrase, any_value(p) as p, k, count(*) as f from grams group by lang, phrase, k having count(*) >= 100),
    cuts as (
      select c.lang, c.phrase, c.p, c.k, c.f as a, x.f as l, y.f as r, i, n, ((1000::hugeint * c.f * n) // (x.f::hugeint * y.f))::bigint as score
      from (select *, unnest(range(1, k)) as i from counts where k >= 2) c
      join totals using (lang)
      join counts x on x.lang = c.lang and x.phrase = array_to_string(c.p[1 : i], ' ')
      join counts y on y.lang = c.lang and y.phrase = array_to_string(c.p[i + 1 :], ' ')),
    weakest as (
      select lang, phrase, any_value(p) as p, k, a, n, min(score) as score, arg_min(l, score * 8 + i) as l, arg_min(r, score * 8 + i) as r
      from cuts group by lang, phrase, k, a, n),
    inside as (
      select distinct lang, array_to_string(p[i : j], ' ') as phrase, f
      from (select *, unnest(range(i, k + 1)) as j from (select *, unnest(range(1, k + 1)) as i from counts)) where j - i + 1 between 2 and k - 1),
    kept as (
      select * from weakest w
      where not exists (select 1 from inside s where s.lang = w.lang and s.phrase = w.phrase and 100 * s.f >= 100 * w.a))
    select lang, rank, phrase, a, l, r, n, score
    from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) where rank <= 2000"""


@query("op11_phrases", PHRASES_SQL)
def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents").select("lang", "text"), 100, 2000)
