"""The staged estimate pipeline: raw extract, bronze, silver, gold, panel with event windows, splits, records, chat records, validation."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.functions import clean as C
from skarn.operators import consensus as K
from skarn.operators import records as R
from skarn.operators import resolve as J
from skarn.operators import returns as W
from skarn.operators import splitting as S
from skarn.sources.contracts import BENCHMARK_ALIASES, ESTIMATE_COLUMNS, ContractError, resolve_aliases
from skarn.sources.readers import read_contract_csv, read_settings
from skarn.sources.sinks import materialise

STAGES = ("bronze", "silver", "gold", "panel", "records", "chats", "validation")
# Column and field names of tables and records, and the event's type.
EVENT_TYPE = "ibes_analyst_revision_consensus"
GROUP = ["company_key", "ticker_norm", "oftic_norm", "cusip8", "company_name_norm", "event_date", "fpi_norm", "fiscal_period_end_date", "measure_norm", "report_currency_norm"]


@dataclass(frozen=True)
class PipelineConfig:
    estimates: str
    out: str
    daily: str | None = None
    benchmark: str | None = None
    seed: int = 42
    neutral_delta: float = 0.005
    neutral_return: float = 0.01
    large_return: float = 0.05
    train_fraction: float = 0.9
    validation_fraction: float = 0.05
    windows: tuple[str, ...] = ("0:1", "0:3", "0:5", "-1:1")
    match_days: int = 7
    caps: dict[str, int] = field(default_factory=dict)  # rows per split; 0 or absent: all
    header: str | None = None
    benchmark_column: str = "vwretd"
    train_eval: int = 500  # rows of 'val' shown while training, as the split train_eval
    sample: int = 100  # rows of 'train' to look at, as the split sample_100

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> PipelineConfig:
        """From a settings file; a section named pipeline or the whole file. Unknown names are an error."""
        x = read_settings(spark, path)
        x = dict(x.get("pipeline") or x)
        if gone := sorted(set(x) - set(cls.__dataclass_fields__)):
            raise ContractError(f"unknown settings: {', '.join(gone)}")
        if "windows" in x:
            x["windows"] = tuple(x["windows"])
        return cls(**x)


def bronze(raw: DataFrame) -> DataFrame:
    """Text trimmed, blanks null, dates and numbers parsed (bad ones null), normalised keys beside the raw columns."""
    x = C.clean_columns(raw, [c for c in ESTIMATE_COLUMNS if c not in ("VALUE", "USFIRM")])
    day = lambda c: C.safe_date(F.col(c))
    x = x.withColumns({"VALUE": C.safe_number(F.col("VALUE")), "usfirm_flag": C.safe_number(F.col("USFIRM"), "int"), **{c: day(c) for c in ("ACTDATS", "REVDATS", "ANNDATS", "FPEDATS")}})
    x = x.withColumns({
        "ticker_norm": F.upper("TICKER"), "oftic_norm": F.upper("OFTIC"), "cusip8": C.id_prefix(F.col("CUSIP")), "company_name_norm": F.upper("CNAME"), "measure_norm": F.upper("MEASURE"),
        "currfl_norm": F.upper("CURRFL"), "pdf_norm": F.upper("PDF"), "fpi_norm": F.col("FPI"), "report_currency_norm": F.upper("report_curr"), "estimate_currency_norm": F.upper("CURR"),
        "event_date": F.coalesce("REVDATS", "ANNDATS", "ACTDATS"), "event_time": F.coalesce("REVTIMS", "ANNTIMS", "ACTTIMS"),
    })
    return x.withColumn("company_key", F.coalesce("oftic_norm", "ticker_norm", "cusip8"))


SILVER_RULES = {
    "eps_rows": "measure_norm = 'EPS'",
    "us_rows": "usfirm_flag = 1",
    "current_rows": "coalesce(currfl_norm, 'C') = 'C'",
    "usd_rows": "coalesce(report_currency_norm, 'USD') = 'USD'",
    "dated_rows": "event_date is not null",
    "valued_rows": "VALUE is not null",
    "keyed_rows": "company_key is not null",
}

RENAMED = {
    "ANALYS": "analyst_id", "ESTIMATOR": "estimator_id", "VALUE": "estimate_value", "ACTDATS": "actual_date", "REVDATS": "revision_date", "ANNDATS": "announce_date",
    "FPEDATS": "fiscal_period_end_date", "ACTTIMS": "actual_time", "REVTIMS": "revision_time", "ANNTIMS": "announce_time",
}


def silver(b: DataFrame) -> DataFrame:
    """Rows that meet every rule, one per estimate; of repeated ones the first by all remaining columns."""
    for rule in SILVER_RULES.values():
        b = b.where(rule)
    keys = ["company_key", "ticker_norm", "oftic_norm", "cusip8", "ANALYS", "ESTIMATOR", "FPI", "FPEDATS", "event_date", "VALUE"]
    rest = [F.col(c).asc_nulls_last() for c in b.columns if c not in keys]
    return K.latest_per_key(b, keys, rest).withColumnsRenamed(RENAMED)


def gold(s: DataFrame, neutral: float = 0.005) -> DataFrame:
    """One row per consensus event with change labels and event_id (company, date, horizon, period; not unique)."""
    g = K.consensus(s, GROUP, "estimate_value", "analyst_id", "estimator_id", ["actual_date", "announce_date", "revision_date", "event_time"])
    g = g.withColumnsRenamed({f"first_{c}": c for c in ("actual_date", "announce_date", "revision_date", "event_time")})
    order = [F.col("event_date"), F.coalesce("event_time", F.lit("00:00:00")), F.coalesce("ticker_norm", F.lit("")), *[F.col(c).asc_nulls_first() for c in GROUP]]
    g = g.withColumn("history_key", C.composite_key(F.col("company_key"), F.col("fpi_norm"), F.col("fiscal_period_end_date")))
    g = K.with_change_labels(g, ["history_key"], order, neutral).drop("history_key")
    return g.withColumn("event_id", C.composite_key(F.col("company_key"), F.col("event_date"), F.col("fpi_norm"), F.col("fiscal_period_end_date")))


def daily_silver(raw: DataFrame) -> DataFrame:
    """permno, trade_date, identifiers, price (absolute), ret, trade_idx; one row per security, date and identifiers."""
    text = lambda c: F.upper(F.trim(c))
    x = raw.select(
        C.safe_number(F.col("PERMNO"), "int").alias("permno"), C.safe_date(F.col("date")).alias("trade_date"), C.id_prefix(F.col("CUSIP")).alias("cusip8"), C.id_prefix(F.col("NCUSIP")).alias("ncusip8"),
        text("TICKER").alias("ticker_norm"), F.abs(C.safe_number(F.col("PRC"))).alias("price"), C.safe_number(F.col("RET")).alias("ret"),
    ).where("permno is not null and trade_date is not null and ret is not null")
    keys = ["permno", "trade_date", "cusip8", "ncusip8", "ticker_norm"]
    x = K.latest_per_key(x, keys, [F.col("ret"), F.col("price").asc_nulls_last()])
    return W.trade_index(x, "permno", [F.col(c) for c in keys[1:]])


def presence_bronze(raw: DataFrame) -> DataFrame:
    """permno, presence_date: the days a security is listed at all."""
    x = raw.select(C.safe_number(F.col("PERMNO"), "int").alias("permno"), C.safe_date(F.col("date")).alias("presence_date"))
    return x.where("permno is not null and presence_date is not null").distinct()


def benchmark_bronze(raw: DataFrame, column: str = "vwretd") -> DataFrame:
    """trade_date, benchmark_return: one of the file's index columns, whatever others it has; one row per day, null returns dropped."""
    found, missing = resolve_aliases(raw.columns, {"date": BENCHMARK_ALIASES["date"], "return": (column,)})
    if missing:
        raise ContractError(f"benchmark: no column for {', '.join(missing)} among {', '.join(raw.columns)}")
    b = raw.select(C.safe_date(F.col(found["date"])).alias("trade_date"), C.safe_number(F.col(found["return"])).alias("benchmark_return")).where("trade_date is not null and benchmark_return is not null")
    return b.groupBy("trade_date").agg(F.min("benchmark_return").alias("benchmark_return"))


def header_silver(raw: DataFrame) -> DataFrame:
    """permno, cusip8, header_ticker, beg_date, end_date (null: open) of the dated stock header, without repeated rows."""
    text = lambda c: F.upper(F.nullif(F.trim(c), F.lit("")))
    return raw.select(
        C.safe_number(F.col("PERMNO"), "int").alias("permno"), C.id_prefix(text("CUSIP")).alias("cusip8"), F.coalesce(text("HTSYMBOL"), text("HTICK")).alias("header_ticker"),
        C.safe_date(F.col("BEGDAT")).alias("beg_date"), C.safe_date(F.col("ENDDAT")).alias("end_date"),
    ).where("permno is not null and beg_date is not null").distinct()


def header_keys(base: DataFrame, header: DataFrame) -> DataFrame:
    """Event keys through the stock header: the permno whose entry has the event's identifier on the event's day."""

    def route(name: str, column: str, identifier: str, confidence: float) -> DataFrame:
        events = base.select("event_id", "event_date", F.col(identifier).alias("id"))
        entries = header.select(F.col(column).alias("id"), "permno", "beg_date", "end_date")
        found = J.interval_join(events, entries, ["id"], "event_date", "beg_date", "end_date")
        return J.event_keys(found, "event_id", "event_date", {name: (F.col("permno"), confidence)})

    return J.union_all([route("cusip8_header", "cusip8", "cusip8", 0.7), route("ticker_header", "header_ticker", "oftic_norm", 0.6)]).distinct()


def panel(g: DataFrame, daily: DataFrame | None, benchmark: DataFrame | None, cfg: PipelineConfig, header: DataFrame | None = None) -> DataFrame:
    """Gold events with a prior consensus, one per event_id, their security, event windows and realised labels.

    ``benchmark``: trade_date, benchmark_return. ``header``: what header_silver gives; without it securities are found by
    the identifiers of the daily data only. Without daily data every event is unmatched.
    """
    base = K.latest_per_key(g.where("prior_consensus_median is not null"), ["event_id"], [F.coalesce(c, F.lit("")) for c in ("ticker_norm", "cusip8", "company_name_norm", "measure_norm", "report_currency_norm")])
    cols = {f"{k}_{W.window_slug(w)}": "bigint" if k == "obs_count" else "double" for w in cfg.windows for k in ("raw_return", "obs_count", "benchmark_return", "abnormal_return")}
    if daily is None:
        nothing = {"security": "int", "anchor_day": "date", "join_method": "string", "join_confidence": "double", **cols}
        x = base.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}).withColumns({"join_method": F.lit("none"), "join_confidence": F.lit(0.0), "join_status": F.lit("unmatched")})
    else:
        keys = J.event_keys(base, "event_id", "event_date", {"cusip8": (F.col("cusip8"), 0.95), "ncusip8": (F.col("cusip8"), 0.9), "ticker": (F.col("oftic_norm"), 0.75)})
        names = {"cusip8": F.col("cusip8"), "ncusip8": F.col("ncusip8"), "ticker": F.col("ticker_norm")}
        if header is not None:
            keys = keys.unionByName(header_keys(base, header))
            names |= {"cusip8_header": F.col("permno"), "ticker_header": F.col("permno")}
        sec = J.security_keys(daily, "permno", "trade_date", names)
        x = J.with_resolution(base, "event_id", J.resolve_first(keys, sec, cfg.match_days))
        d = daily.join(benchmark, "trade_date", "left") if benchmark is not None else daily.withColumn("benchmark_return", F.lit(None).cast("double"))
        w = W.window_returns(d, "permno", list(cfg.windows), benchmark="benchmark_return")
        # a day with several identifier rows is anchored at the first of them
        w = K.latest_per_key(w, ["permno", "trade_date"], [F.col("trade_idx")]).select(F.col("permno").alias("security"), F.col("trade_date").alias("anchor_day"), *cols)
        x = x.join(w, ["security", "anchor_day"], "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in cols if c.startswith("obs_count")})
    first = W.window_slug(cfg.windows[0])
    ret = F.coalesce(f"abnormal_return_{first}", f"raw_return_{first}")
    x = x.withColumns({"realized_direction_label": C.realized_direction(ret, cfg.neutral_return), "realized_magnitude_bucket": C.realized_magnitude(ret, cfg.neutral_return, cfg.large_return)})
    return x.withColumn("alignment_label", C.alignment(F.col("direction_label"), F.col("realized_direction_label")))


def split_rows(p: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Panel rows with their chronological split, capped if the configuration says so."""
    x = S.chronological_split(p.where(F.col("direction_label").isin("positive", "negative", "neutral")), "event_date", ["event_id"], cfg.train_fraction, cfg.validation_fraction)
    if any(cfg.caps.values()):
        x = J.union_all([S.hash_sample(x.where(F.col("split") == s), "event_id", cfg.caps.get(s, 0), cfg.seed + i) for i, s in enumerate(("train", "val", "test"))])
    return x


def _iso(c: str):
    return F.date_format(c, "yyyy-MM-dd")


def _six(c: str):
    return C.scalar_text(F.col(c), "double")


# Names of counted and averaged features.
COUNTS = ("estimate_count", "analyst_count", "estimator_count")
FIGURES = ("consensus_mean", "consensus_median", "consensus_std", "consensus_min", "consensus_max", "prior_consensus_mean", "prior_consensus_median", "consensus_delta", "consensus_pct_change")


def records(p: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """split, event_id, source, instruction, input, output: chronological splits rendered as instruction records."""
    inputs = {
        "task": F.lit("classify analyst revision event"),
        "company": {"company_key": F.col("company_key"), "ticker": F.col("ticker_norm"), "oftic": F.col("oftic_norm"), "cusip8": F.col("cusip8"), "company_name": F.col("company_name_norm")},
        "event": {
            "event_id": F.col("event_id"), "event_type": F.lit(EVENT_TYPE), "event_date": _iso("event_date"), "event_time": F.col("event_time"), "fiscal_period_end_date": _iso("fiscal_period_end_date"), "fpi": F.col("fpi_norm"),
            "currency": F.col("report_currency_norm"),
        },
        "features": {**{c: F.col(c) for c in COUNTS}, **{c: _six(c) for c in FIGURES}},
    }
    outputs = {"direction_label": F.col("direction_label"), "magnitude_bucket": F.col("magnitude_bucket"), "event_type": F.lit(EVENT_TYPE)}
    return R.instruct_record(split_rows(p, cfg), "Name the direction and the size of this change of consensus.", inputs, outputs, [F.col("event_id"), F.lit("estimates").alias("source"), F.col("split")])


#: Keys an assistant's answer must have.
ANSWER_KEYS = ("event_type", "direction", "magnitude", "alignment")


def chats(p: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """Chat records of every split, and of train_eval (rows of 'val') and sample_100 (rows of 'train'), by hash order.

    messages (system, user, assistant), instruction, input, output, event_id, source, event_date, direction_label,
    realized_direction_label, alignment_label, split.
    """
    x = split_rows(p, cfg)
    extra = lambda of, name, n, seed: S.hash_sample(x.where(F.col("split") == of), "event_id", n, cfg.seed + seed).withColumn("split", F.lit(name))
    parts = [x] + [extra(*e) for e in (("val", "train_eval", cfg.train_eval, 50), ("train", "sample_100", cfg.sample, 100)) if e[2]]
    x = J.union_all(parts)
    returns = [f"{k}_{W.window_slug(w)}" for w in cfg.windows if W.parse_window(w)[0] >= 0 for k in ("raw_return", "abnormal_return")]
    payload = R.nested_json({
        "task": F.lit("classify event-driven signal"),
        "company": {"company_key": F.col("company_key"), "ticker": F.col("ticker_norm"), "oftic": F.col("oftic_norm"), "cusip8": F.col("cusip8"), "company_name": F.col("company_name_norm"), "permno": F.col("security")},
        "event": {
            "event_id": F.col("event_id"), "event_type": F.lit(EVENT_TYPE), "event_date": _iso("event_date"), "anchor_trade_date": _iso("anchor_day"), "fiscal_period_end_date": _iso("fiscal_period_end_date"), "fpi": F.col("fpi_norm"),
            "join_status": F.col("join_status"), "join_method": F.col("join_method"), "join_confidence": F.col("join_confidence"),
        },
        "features": {**{c: F.col(c) for c in COUNTS}, **{c: _six(c) for c in ("consensus_mean", "consensus_median", "prior_consensus_median", "consensus_delta", "consensus_pct_change", "consensus_std", *returns)}, "alignment_label": F.col("alignment_label")},
    })
    answer = R.nested_json({"event_type": F.lit(EVENT_TYPE), "direction": F.col("direction_label"), "magnitude": F.col("magnitude_bucket"), "alignment": F.col("alignment_label")})
    carry = [
        F.lit("Describe the event's signal as one JSON object.").alias("instruction"), F.col("payload").alias("input"), F.col("answer").alias("output"), F.col("event_id"), F.lit("estimates").alias("source"),
        _iso("event_date").alias("event_date"), *[F.col(c) for c in ("direction_label", "realized_direction_label", "alignment_label", "split")],
    ]
    system = f"You read analyst revisions. Answer with one JSON object that has the keys {', '.join(ANSWER_KEYS)}."
    return R.chat_record(x.withColumns({"payload": payload, "answer": answer}), system, F.concat(F.lit("Which signal does this revision give?\n"), F.col("payload")), F.col("answer"), carry)


def validation(c: DataFrame) -> DataFrame:
    """split, event_id, error: faults of chat records, and events that stand in more than one of train, val and test."""
    faults = R.record_errors(c.withColumn("__id", F.struct("split", "event_id")), "__id", F.col("input"), F.col("output"), F.col("messages"), list(ANSWER_KEYS)).select("__id.split", "__id.event_id", "error")
    leaks = S.split_overlap(c.where(F.col("split").isin("train", "val", "test")), "split", "event_id")
    return faults.unionByName(leaks.select(F.col("split_list").alias("split"), "event_id", F.lit("stands in several splits").alias("error")))


def run(spark: SparkSession, cfg: PipelineConfig, start: str = "bronze", through: str = "records", force: bool = False) -> DataFrame:
    """Run stages in order and return the last table; finished stages of the same configuration and input files are reused.

    ``force`` rebuilds the stages from ``start`` on. Each stage is a table under ``cfg.out``. The stage validation is a gate: it
    raises if there is any fault.
    """
    first, last = STAGES.index(start), STAGES.index(through)
    if first > last:
        raise ValueError(f"{start} comes after {through}")
    conf = asdict(cfg)
    at: dict[str, DataFrame] = {}

    def read_daily() -> DataFrame | None:
        return daily_silver(spark.read.option("header", True).csv(cfg.daily)) if cfg.daily else None

    def read_header() -> DataFrame | None:
        return header_silver(spark.read.option("header", True).csv(cfg.header)) if cfg.header else None

    def read_benchmark() -> DataFrame | None:
        if not cfg.benchmark:
            return None
        return benchmark_bronze(spark.read.option("header", True).csv(cfg.benchmark), cfg.benchmark_column)

    build = {
        "bronze": lambda: bronze(read_contract_csv(spark, cfg.estimates, ESTIMATE_COLUMNS)),
        "silver": lambda: silver(at["bronze"]),
        "gold": lambda: gold(at["silver"], cfg.neutral_delta),
        "panel": lambda: panel(at["gold"], read_daily(), read_benchmark(), cfg, read_header()),
        "records": lambda: records(at["panel"], cfg),
        "chats": lambda: chats(at["panel"], cfg),
        "validation": lambda: validation(at["chats"]),
    }
    files = [cfg.estimates]
    for i, stage in enumerate(STAGES[: last + 1]):
        if stage == "panel":
            files = files + [f for f in (cfg.daily, cfg.benchmark, cfg.header) if f]
        at[stage] = materialise(spark, f"{cfg.out}/{stage}", conf, build[stage], force and i >= first, files)
        if stage == "validation":
            R.require_valid(at[stage])
    return at[through]
