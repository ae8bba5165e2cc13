"""Text, JSON and record queries over documents, events and rendered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import text as X
from skarn.functions.tokens import token_length
from skarn.operators import profile as P
from skarn.operators import records as R
from skarn.operators.resolve import union_all
from skarn.sources.html import html_text
from skarn.sources.tables import table as T

REQUIRED = ["task", "company", "event", "features"]


def text_signature(spark, d):
    return T(spark, d, "documents").where("text is not null").select("doc_id", X.sha1_text(X.squashed(F.col("text"))).alias("sig"))


def exact_dups(spark, d):
    return P.duplicate_rate(T(spark, d, "documents").where("text is not null"), [], F.md5("text"))


def norm_dups(spark, d):
    """Duplicates after case and white space are evened out, per split of the rendered records."""
    return P.duplicate_rate(T(spark, d, "ibes_pipeline"), ["split"], X.sha1_text(X.squashed(F.col("structured_input"))))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs made from records by a rule: plain JSON, reasoning before it, broken tags, prose, or a word."""
    r = F.col("record_id")
    kind = F.when(r % 4 < 2, F.lit(', "event_type": "ibes_analyst_revision_consensus"')).otherwise(F.lit(""))
    answer = F.concat(F.lit('{"direction_label": "'), F.coalesce(F.lower("direction_label"), F.lit("none")), F.lit('", "magnitude_bucket": "'), F.coalesce(F.lower("magnitude_bucket"), F.lit("none")), F.lit('"'), kind, F.lit("}"))
    out = (
        F.when(r % 6 == 0, answer).when(r % 6 == 1, F.concat(F.lit("<think>\nweigh "), F.coalesce("ticker", F.lit("it")), F.lit(" {x}\n</think>\n"), answer))
        .when(r % 6 == 2, F.concat(F.lit("<think>open "), answer)).when(r % 6 == 3, F.concat(F.lit("The answer is "), answer, F.lit(" as asked.")))
        .when(r % 6 == 4, F.concat(F.lit("Not Positive: magnitude_bucket = Medium, event_type: ibes_surprise, "), F.coalesce("direction_label", F.lit("unsure")))).otherwise(F.lit("no idea"))
    )
    x = T(spark, d, "ibes_pipeline").select("record_id", "split", "direction_label", "magnitude_bucket", F.get_json_object("structured_input", "$.event.event_type").alias("event_type"), out.alias("raw_output"))
    # what a run measures beside its output
    return x.withColumns({"generated_tokens": F.size(F.split("raw_output", " ")), "latency_seconds": (r % 100) / 50.0, "output_truncated": r % 11 == 0})


def think_parse(spark, d):
    p = X.think_parts(F.col("raw_output"))
    return _outputs(spark, d).select("record_id", *[p[k].alias(k) for k in ("contains_think", "think_text", "malformed", "stripped", "has_answer", "json_after_text")])


def label_extract(spark, d):
    return _outputs(spark, d).select("record_id", X.label_in_text(X.think_parts(F.col("raw_output"))["stripped"]).alias("label"))


def json_recover(spark, d):
    return _outputs(spark, d).select("record_id", F.get_json_object(X.json_blob(X.think_parts(F.col("raw_output"))["stripped"]), "$.direction_label").alias("direction"))


def parsed_predictions(spark: SparkSession, d: str) -> DataFrame:
    """record_id, gold and parsed direction, magnitude and event type, flags of the output, raw_output and what a run measures."""
    x = _outputs(spark, d)
    think = X.think_parts(F.col("raw_output"))
    x = x.withColumns({"final": think["stripped"], "contains_think": think["contains_think"], "malformed": think["malformed"], "json_after_text": think["json_after_text"], "has_answer": think["has_answer"]})
    x = x.withColumn("blob", X.json_blob(F.col("final")))
    word = X.label_in_text(F.col("final"))
    direction = F.coalesce(X.structured_field(F.col("blob"), F.col("final"), "direction_label", ("direction",)), F.when(word.isin("positive", "negative", "neutral"), word))
    # fixed values: the forms in which prose states a field
    magnitude = X.structured_field(F.col("blob"), F.col("final"), "magnitude_bucket", pattern=r'(?i)"?magnitude_bucket"?\s*[:=]\s*"?(small|medium|large|unknown)"?')
    event_type = X.structured_field(F.col("blob"), F.col("final"), "event_type", pattern=r'(?i)"?event_type"?\s*[:=]\s*"?(ibes_[a-z_]+)"?')
    return x.select(
        "record_id", F.lower("direction_label").alias("gold"), F.lower("magnitude_bucket").alias("gold_magnitude"), F.col("event_type").alias("gold_event_type"), direction.alias("pred"), magnitude.alias("pred_magnitude"),
        event_type.alias("pred_event_type"), F.col("blob").isNotNull().alias("format_compliant"), "contains_think", "malformed", "json_after_text", "has_answer", "raw_output", "generated_tokens", "latency_seconds", "output_truncated",
    )


def structured_parse(spark, d):
    return parsed_predictions(spark, d).select("record_id", "pred", "pred_magnitude", "pred_event_type", "format_compliant")


def json_field(spark, d):
    e = T(spark, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), X.json_template(F.col("props")).alias("template"))


def json_keys(spark, d):
    return T(spark, d, "ibes_pipeline").groupBy(X.json_template(F.col("structured_input")).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def html_excerpt(spark, d):
    """Visible text of each document, from its first form marker on, with an excerpt; parsed with the standard HTML parser."""
    x = T(spark, d, "documents").where("text is not null").select("doc_id", html_text(F.col("text")).alias("t"))
    return x.select("doc_id", *[c.alias(k) for k, c in X.excerpt(F.col("t"), 200).items()])


def instruct_records(spark, d):
    """Line-item consensus events rendered as instruction records; JSON keys sorted at both levels."""
    from skarn.plans.estimates import gold

    g = gold(spark, d)
    r = lambda c: F.round(c, 6)
    inputs = {
        "task": F.lit("classify revision"), "company": {"company_key": F.col("company").cast("string")}, "event": {"period": F.date_format("period", "yyyy-MM-dd")},
        "features": {"estimate_count": F.col("estimate_count"), "consensus_median": r("consensus_median"), "consensus_std": r("consensus_std"), "prior_consensus_median": r("prior_consensus_median")},
    }
    x = R.instruct_record(g, "Classify the revision.", inputs, {"direction_label": F.col("direction_label"), "magnitude_bucket": F.col("magnitude_bucket")}, [F.concat_ws("|", "company", "period").alias("event_id")])
    # numbers are compared as numbers, not as text
    n = lambda k: F.round(F.get_json_object("input", f"$.features.{k}").cast("double"), 2)
    return x.select("event_id", "output", F.get_json_object("input", "$.company.company_key").alias("company_key"), F.get_json_object("input", "$.event.period").alias("period"), n("estimate_count").alias("estimate_count"), n("consensus_median").alias("consensus_median"), n("consensus_std").alias("consensus_std"), n("prior_consensus_median").alias("prior_consensus_median"))


#: Leaves in which records that are the same event's may differ.
VOLATILE = ("event.event_id", "event.event_time", "company.company_name")


def input_signature_dups(spark, d):
    """Records equal in every leaf but event id, time and company name."""
    return P.duplicate_rate(T(spark, d, "ibes_pipeline"), ["split"], X.json_signature(F.col("structured_input"), VOLATILE))


def event_signatures(spark, d):
    """A digest of an event's normalised fields; repeated deliveries and spellings agree."""
    e = T(spark, d, "ibes_gold_events_sample")
    return e.select("event_id", "cusip", X.signature(F.col("ticker"), F.col("event_date"), F.col("label_direction"), F.col("label_magnitude")).alias("sig")).distinct()


def coverage_growth(spark, d):
    """What the training split covers beyond evaluation and holdout: companies, days, periods and input signatures."""
    x = T(spark, d, "ibes_pipeline").withColumn("sig", X.json_signature(F.col("structured_input"), VOLATILE))
    of = {"company": "$.company.company_key", "day": "$.event.event_date", "period": "$.event.fiscal_period_end_date"}
    x = x.select("split", "sig", *[F.get_json_object("structured_input", p).alias(k) for k, p in of.items()])
    return P.coverage_growth(x.where("split <> 'train'"), x.where("split = 'train'"), [*of, "sig"])


def key_contamination(spark, d):
    """Outputs that speak the structured schema, per split."""
    x = _outputs(spark, d).withColumn("hit", X.mentions_any(F.col("raw_output"), ["direction_label", "magnitude_bucket"]))
    return x.groupBy("split").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))


def token_lengths(spark, d):
    """Lengths of inputs in tokens of a public tokenizer, per split."""
    x = T(spark, d, "ibes_pipeline").where("structured_input is not null").select("split", token_length(F.col("structured_input")).alias("tokens"))
    return P.nearest_rank(x, ["split"], "tokens", [0.5, 0.95]).join(x.groupBy("split").agg(F.round(F.avg("tokens"), 2).alias("mean"), F.max("tokens").alias("most")), "split")


#: Instruction templates; {kind} is the item's kind.
TEMPLATES = {"news": "Which tone has this piece of finance {kind}? Answer negative, neutral or positive.", "record": "Which direction has this {kind}? Answer negative, neutral or positive."}


def templated_instructions(spark, d):
    """Instructions filled from a template by the kind of item."""
    x = T(spark, d, "documents").select("doc_id", F.when(F.lower("source").contains("headline"), "headline").otherwise(F.coalesce(F.lower(F.trim("source")), F.lit("text"))).alias("kind"))
    return x.select("doc_id", X.templated(F.lit(TEMPLATES["news"]), {"kind": F.col("kind")}).alias("instruction"))


def dataset_card(spark, d):
    x = T(spark, d, "ibes_pipeline")
    return P.dataset_card(x, ["source", "ticker", "direction_label", "magnitude_bucket"], F.md5("structured_input"), "structured_input")


def dataset_shares(spark, d):
    """Shares of sources, labels, years and templates: the distributions of a dataset's card."""
    x = T(spark, d, "ibes_pipeline").withColumns({"year": F.substring(F.get_json_object("structured_input", "$.event.event_date"), 1, 4), "template": X.json_template(F.col("structured_input"))})
    return P.shares(x, ["source", "direction_label", "magnitude_bucket", "year", "template"])


def _chats(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("record_id")
    answer = F.when(r % 9 == 0, F.lit("{broken")).when(r % 9 == 1, F.lit('{"task": 1}')).otherwise(F.col("structured_input"))
    x = T(spark, d, "ibes_pipeline").select("record_id", F.when(r % 8 != 0, F.col("instruction")).alias("input"), answer.alias("answer"), F.when(r % 10 == 0, F.lit("else")).otherwise(answer).alias("output"), "instruction")
    return R.chat_record(x, "Return JSON only.", F.col("instruction"), F.col("answer"), [F.col("record_id"), F.col("input"), F.col("output")])


def chat_records(spark, d):
    return _chats(spark, d).select("record_id", F.size("messages").alias("turns"), F.element_at("messages", 1)["role"].alias("first_role"), F.md5(X.chat_text(F.col("messages"))).alias("chat_digest"))


def record_validation(spark, d):
    e = R.record_errors(_chats(spark, d), "record_id", F.col("input"), F.col("output"), F.col("messages"), REQUIRED)
    return e.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def record_union(spark, d):
    """Training records and documents as records of one layout; what a side lacks is null."""
    a = T(spark, d, "ibes_pipeline").select(F.col("record_id").cast("string").alias("id"), F.lower("source").alias("source"), "instruction", F.col("structured_input").alias("input"), F.lower("direction_label").alias("target_label"))
    b = T(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), F.lower(F.trim("source")).alias("source"), F.col("text").alias("input"))
    x = union_all([a, b], missing=True)
    return x.groupBy("source", "target_label").agg(F.count(F.lit(1)).alias("n"), F.count("instruction").alias("instructions"), F.sum(F.length("input")).alias("characters"))


def score_labels(spark, d):
    x = T(spark, d, "events").select("event_id", (F.col("value") / 100 - 0.5).alias("score"))
    return x.select("event_id", X.score_label(F.col("score")).alias("label"))


QUERIES = {f.__name__: f for f in (
    text_signature, exact_dups, norm_dups, think_parse, label_extract, json_recover, structured_parse, json_field, json_keys, html_excerpt, input_signature_dups, event_signatures, coverage_growth, key_contamination, token_lengths, templated_instructions, dataset_card, dataset_shares, instruct_records, chat_records, record_validation, record_union, score_labels,
)}

_SQUASH = lambda c: rf"trim(regexp_replace(lower({c}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
OUTPUTS_SQL = r"""ans as (select *, '{"direction_label": "' || coalesce(lower(direction_label), 'none') || '", "magnitude_bucket": "' || coalesce(lower(magnitude_bucket), 'none') || '"' || case when record_id % 4 < 2 then ', "event_type": "ibes_analyst_revision_consensus"' else '' end || '}' as a from ibes_pipeline),
outs as (select record_id, split, direction_label, magnitude_bucket, json_extract_string(structured_input, '$.event.event_type') as event_type, case record_id % 6 when 0 then a when 1 then '<think>' || chr(10) || 'weigh ' || coalesce(ticker, 'it') || ' {x}' || chr(10) || '</think>' || chr(10) || a
  when 2 then '<think>open ' || a when 3 then 'The answer is ' || a || ' as asked.' when 4 then 'Not Positive: magnitude_bucket = Medium, event_type: ibes_surprise, ' || coalesce(direction_label, 'unsure') else 'no idea' end as raw from ans),
th as (select *, regexp_matches(raw, '(?s)<think>.*?</think>') as has, (length(raw) - length(replace(raw, '<think>', ''))) // 7 as op, (length(raw) - length(replace(raw, '</think>', ''))) // 8 as cl,
  regexp_replace(regexp_replace(raw, '(?s)<think>.*?</think>', ''), '^\s+|\s+$', '', 'g') as stripped from outs),
lab as (select *, case when contains(lower(stripped), 'positive') then 'positive' when contains(lower(stripped), 'negative') then 'negative' when contains(lower(stripped), 'neutral') then 'neutral'
  when regexp_matches(lower(stripped), '\byes\b') then 'yes' when regexp_matches(lower(stripped), '\bno\b') then 'no' end as label,
  regexp_extract(stripped, '(?s)\{.*\}') as blob from th),
prs as (select *, case when blob <> '' then json_extract_string(blob, '$.direction_label') end as jd, case when blob <> '' then json_extract_string(blob, '$.magnitude_bucket') end as jm, case when blob <> '' then json_extract_string(blob, '$.event_type') end as je from lab),
pred as (select record_id, lower(direction_label) as gold, lower(magnitude_bucket) as gold_magnitude, coalesce(jd, case when label in ('positive', 'negative', 'neutral') then label end) as pred,
  coalesce(jm, nullif(lower(regexp_extract(stripped, '(?i)"?magnitude_bucket"?\s*[:=]\s*"?(small|medium|large|unknown)"?', 1)), '')) as pred_magnitude, blob <> '' as format_compliant, raw as raw_output, event_type as gold_event_type, coalesce(je, nullif(lower(regexp_extract(stripped, '(?i)"?event_type"?\s*[:=]\s*"?(ibes_[a-z_]+)"?', 1)), '')) as pred_event_type,
  op > 0 or cl > 0 as contains_think, op <> cl or op > 1 or cl > 1 or (not has and (op > 0 or cl > 0)) as malformed, instr(stripped, '{') > 1 and length(trim(substr(stripped, 1, instr(stripped, '{') - 1))) > 0 as json_after_text, length(stripped) > 0 as has_answer,
  len(string_split(raw, ' ')) as generated_tokens, (record_id % 100) / 50.0 as latency_seconds, record_id % 11 = 0 as output_truncated from prs)"""

#: Every leaf of every record, opened in SQL, without those in VOLATILE.
SIGS_SQL = f"""jk as (select record_id, structured_input as j, unnest(json_keys(structured_input)) as a from ibes_pipeline where json_valid(structured_input)),
jl as (select record_id, j, a, unnest(case when json_type(j, '$."' || a || '"') = 'OBJECT' then json_keys(j, '$."' || a || '"') else [null] end) as b from jk),
jv as (select record_id, coalesce(a || '.' || b, a) as p, json_extract_string(j, '$."' || a || '"' || coalesce('."' || b || '"', '')) as x from jl where coalesce(a || '.' || b, a) not in {VOLATILE}),
js as (select record_id, string_agg(p || '=' || coalesce(cast(try_cast(x as double) as varchar), x, '~'), '|' order by p) as sig from jv group by record_id),
sigs as (select i.*, coalesce(sig, 'none') as sig from ibes_pipeline i left join js using (record_id))"""
_KEYS = "array_to_string(list_sort(json_keys({0})), ',')"

SQL = {
    "text_signature": f"select doc_id, sha1({_SQUASH('text')}) as sig from documents where text is not null",
    "exact_dups": "select count(*) as rows, count(*) - count(distinct text) as duplicates, round((count(*) - count(distinct text)) / count(*), 4) as rate from documents where text is not null",
    "norm_dups": f"select split, count(*) as rows, count(*) - count(distinct {_SQUASH('structured_input')}) as duplicates, round((count(*) - count(distinct {_SQUASH('structured_input')})) / count(*), 4) as rate from ibes_pipeline group by split",
    "think_parse": rf"""with {OUTPUTS_SQL} select record_id, op > 0 or cl > 0 as contains_think, case when has then regexp_extract(raw, '(?s)<think>(.*?)</think>', 1) end as think_text,
  op <> cl or op > 1 or cl > 1 or (not has and (op > 0 or cl > 0)) as malformed, stripped, length(stripped) > 0 as has_answer, instr(stripped, '{{') > 1 and length(trim(substr(stripped, 1, instr(stripped, '{{') - 1))) > 0 as json_after_text from th""",
    "label_extract": f"with {OUTPUTS_SQL} select record_id, label from lab",
    "json_recover": f"with {OUTPUTS_SQL} select record_id, jd as direction from prs",
    "structured_parse": f"with {OUTPUTS_SQL} select record_id, pred, pred_magnitude, pred_event_type, format_compliant from pred",
    "json_field": f"select event_id, try_cast(json_extract_string(props, '$.k') as integer) as k, {_KEYS.format('props')} as template from events",
    "json_keys": f"select {_KEYS.format('structured_input')} as template, count(*) as n from ibes_pipeline group by 1",
    "input_signature_dups": f"with {SIGS_SQL} select split, count(*) as rows, count(*) - count(distinct sig) as duplicates, round((count(*) - count(distinct sig)) / count(*), 4) as rate from sigs group by split",
    "coverage_growth": f"""with {SIGS_SQL}, y as (select split = 'train' as new, unnest([{{'d': 'company', 'v': json_extract_string(structured_input, '$.company.company_key')}}, {{'d': 'day', 'v': json_extract_string(structured_input, '$.event.event_date')}},
  {{'d': 'period', 'v': json_extract_string(structured_input, '$.event.fiscal_period_end_date')}}, {{'d': 'sig', 'v': nullif(sig, 'none')}}]) as x from sigs where split is not null),
z as (select x.d as dimension, x.v as v, bool_or(not new) as old, bool_or(new) as new from y where x.v is not null group by all)
select dimension, count(*) filter (old) as before, count(*) filter (new) as after, count(*) filter (new and not old) as added, round(1 - count(*) filter (new and not old) / count(*) filter (new), 4) as reuse_rate from z group by dimension""",
    "event_signatures": f"""select distinct event_id, cusip, sha1(concat_ws(chr(31), coalesce({_SQUASH('ticker')}, ''), coalesce(strftime(event_date, '%Y-%m-%d'), ''), coalesce({_SQUASH('label_direction')}, ''), coalesce({_SQUASH('label_magnitude')}, ''))) as sig from ibes_gold_events_sample""",
    "key_contamination": f"with {OUTPUTS_SQL} select split, count(*) filter (contains(raw, 'direction_label') or contains(raw, 'magnitude_bucket')) as hits, count(*) as n from outs group by split",
    "templated_instructions": f"""select doc_id, replace('{TEMPLATES["news"]}', '{{kind}}', case when contains(lower(source), 'headline') then 'headline' else coalesce(lower(trim(source)), 'text') end) as instruction from documents""",
    "dataset_shares": "with x as (select *, substr(json_extract_string(structured_input, '$.event.event_date'), 1, 4) as year, " + _KEYS.format("structured_input") + """ as template from ibes_pipeline),
f as (select unnest([{'d': 'source', 'v': source}, {'d': 'direction_label', 'v': direction_label}, {'d': 'magnitude_bucket', 'v': magnitude_bucket}, {'d': 'year', 'v': year}, {'d': 'template', 'v': template}]) as y from x)
select y.d as dimension, coalesce(y.v, 'UNK') as value, count(*) as n, round(count(*) / (select count(*) from ibes_pipeline), 4) as share from f group by all""",
    "dataset_card": "with f as ("
    + " union all ".join(f"select '{c}' as name, coalesce({c}, 'UNK') as v, count(*) as n from ibes_pipeline group by all" for c in ("source", "ticker", "direction_label", "magnitude_bucket"))
    + """), g as (select name, count(*) as v, round(max(n) / sum(n), 4) as t, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) as e from f group by name)
select 'all' as section, 'rows' as name, count(*)::double as value from ibes_pipeline union all select 'all', 'duplicate_rate', round((count(*) - count(distinct structured_input)) / count(*), 4) from ibes_pipeline
union all select 'all', 'mean_chars', round(avg(length(structured_input)), 2) from ibes_pipeline union all select 'distinct', name, v from g union all select 'top_share', name, t from g union all select 'entropy', name, e from g""",
    "chat_records": """select record_id, 3 as turns, 'system' as first_role, md5('<|im_start|>system' || chr(10) || 'Return JSON only.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
  || case record_id % 9 when 0 then '{broken' when 1 then '{"task": 1}' else structured_input end || '<|im_end|>' || chr(10)) as chat_digest from ibes_pipeline""",
    "record_validation": """with x as (select record_id, case when record_id % 8 <> 0 then instruction end as input, case record_id % 9 when 0 then '{broken' when 1 then '{"task": 1}' else structured_input end as answer from ibes_pipeline),
y as (select *, case when record_id % 10 = 0 then 'else' else answer end as output from x),
e as (select 'empty input' as error from y where trim(coalesce(input, '')) = '' union all select 'output mismatch' from y where answer <> output
  union all select 'invalid json' from y where record_id % 9 = 0 union all select 'missing keys: company, event, features' from y where record_id % 9 = 1)
select error, count(*) as n from e group by error""",
    "record_union": """with x as (select lower(source) as source, lower(direction_label) as target_label, instruction, structured_input as input from ibes_pipeline union all select lower(trim(source)), null, null, text from documents)
select source, target_label, count(*) as n, count(instruction) as instructions, sum(length(input))::bigint as characters from x group by all""",
    "score_labels": "select event_id, case when value / 100 - 0.5 < -0.1 then 'negative' when value / 100 - 0.5 < 0.1 then 'neutral' else 'positive' end as label from events",
}


def _instruct_sql() -> str:
    from skarn.plans.estimates import GOLD_SQL

    return f"""with {GOLD_SQL} select company || '|' || strftime(period, '%Y-%m-%d') as event_id, '{{"direction_label":"' || direction_label || '","magnitude_bucket":"' || magnitude_bucket || '"}}' as output, cast(company as varchar) as company_key,
  strftime(period, '%Y-%m-%d') as period, cast(estimate_count as double) as estimate_count, round(consensus_median, 2) as consensus_median, round(round(consensus_std, 6), 2) as consensus_std, round(prior_consensus_median, 2) as prior_consensus_median from labelled"""


SQL["instruct_records"] = _instruct_sql()
