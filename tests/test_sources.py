import json
import zipfile

import pytest
from pyspark.sql import functions as F

from skarn.operators.records import record_errors
from skarn.plans import pipeline
from skarn.sources import contracts, readers, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_contract_csv(spark, tmp_path):
    p = put(tmp_path / "a.csv", "b,a,extra\n1,2,3\n")
    assert readers.read_contract_csv(spark, p, ["a", "b"]).first().asDict() == {"a": "2", "b": "1"}
    with pytest.raises(contracts.ContractError, match="c"):
        readers.read_contract_csv(spark, p, ["a", "c"])


def test_malformed_rows_are_counted(spark, tmp_path):
    p = put(tmp_path / "a.csv", "a,b\n1,2\n3,4,5\n6,7\n")
    df = readers.read_counted_csv(spark, p).cache()
    assert df.count() == 3 and df.where("_corrupt_record is not null").count() == 1


def test_formats_and_sniffing(spark, tmp_path):
    assert readers.sniff_delimiter("a|b|c\n1|2|3\n") == "|" and readers.sniff_delimiter("word") == ","
    assert readers.read_any(spark, put(tmp_path / "x.csv", "a|b\n1|2\n")).columns == ["a", "b"]
    assert readers.read_any(spark, put(tmp_path / "x.tsv", "a\tb\n1\t2\n")).first()["b"] == "2"
    assert readers.read_any(spark, put(tmp_path / "x.jsonl", '{"a": 1}\n\n{"a": 2}\n')).count() == 2
    with pytest.raises(contracts.ContractError):
        readers.detect_format("x.xlsx")
    assert readers.first_available(spark, [str(tmp_path / "none.csv"), str(tmp_path / "x.tsv")]).count() == 1
    with pytest.raises(contracts.ContractError):
        readers.first_available(spark, [str(tmp_path / "none.csv")])


def test_zip(spark, tmp_path):
    p = tmp_path / "d.zip"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("readme.txt", "no table")
        z.writestr("in/data.csv", 'a,b\n1,"x, y"\n2,\n')
    got = [r.asDict() for r in readers.read_zip_csv(spark, str(p)).orderBy("a").collect()]
    assert got == [{"a": "1", "b": "x, y"}, {"a": "2", "b": None}]


def test_zip_with_line_breaks_in_small_parts(spark, tmp_path):
    """Parts end with a record wherever quoted fields break lines; archives with a header only give no rows."""
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("data.csv", "id,text\n" + "".join(f'{k}-{i},"line {i}\nand ""more"", {k}"\n' for i in range(200 if k < 2 else 0)))
    got = readers.read_zip_csv(spark, str(tmp_path / "*.zip"), part_bytes=500)
    assert got.rdd.getNumPartitions() > 1 and {r["id"]: r["text"] for r in got.collect()} == {f"{k}-{i}": f'line {i}\nand "more", {k}' for k in range(2) for i in range(200)}
    assert readers.read_zip_csv(spark, str(tmp_path / "2.zip")).count() == 0
    with zipfile.ZipFile(tmp_path / "9.zip", "w") as z:
        z.writestr("data.csv", "id,other\n1,2\n")
    with pytest.raises(contracts.ContractError, match="header"):
        readers.read_zip_csv(spark, str(tmp_path / "*.zip"))
    with zipfile.ZipFile(tmp_path / "j.zip", "w") as z:
        z.writestr("x.jsonl", '{"a": 1}\n{"a": 2}\n')
    assert sorted(r["a"] for r in readers.read_any(spark, str(tmp_path / "j.zip")).collect()) == [1, 2]


def test_numbered_lines_settings_and_faults(spark, tmp_path):
    p = put(tmp_path / "n.jsonl", '{"a": 1}\n\nbroken\n{"a": 4}\n')
    assert sorted((r["_line_number"], r["a"]) for r in readers.read_numbered_jsonl(spark, p, "a int").collect()) == [(1, 1), (3, None), (4, 4)]
    got = {r["_line_number"]: r["a"] for r in readers.read_numbered_jsonl(spark, p, "a int").collect()}
    assert got == {1: 1, 3: None, 4: 4}
    text = "# c\npipeline:\n  seed: 42\n  name: 'a # b'  # note\n  share: 0.9\n  on: true\n  none:\n  windows:\n    - '0:1'\n    - -1:1\n  ids: [1, x]\nother: ~\n"
    assert readers.read_settings(spark, put(tmp_path / "c.yaml", text)) == {"pipeline": {"seed": 42, "name": "a # b", "share": 0.9, "on": True, "none": None, "windows": ["0:1", "-1:1"], "ids": [1, "x"]}, "other": None}
    for bad in ("a\n", "a: 1\n  b: 2\n", "- a\n- b\n"):
        with pytest.raises(contracts.ContractError):
            readers.parse_settings(bad)
    assert readers.parse_settings("") == {}
    seen = readers.inspect(spark, put(tmp_path / "x.csv", "a|b\n1|2\n3|4\n"), 1)
    assert seen == {"format": "csv", "delimiter": "|", "columns": ["a", "b"], "samples": [{"a": "1", "b": "2"}]}


def test_exports_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("i", None, "o", 1), (None, "x", None, 2), ("j", "y", "p", 3)], "q string, w string, e string, n int")
    meta = sinks.export_dataset(df, str(tmp_path / "e"), {"instruction": "q", "input": "w", "output": "e"}, "own", "train", most=1)
    assert meta["rows"] == 1 and json.loads(spark.read.text(str(tmp_path / "e/metadata")).first()[0]) == meta
    assert sinks.export_dataset(df, str(tmp_path / "e"), {"instruction": "q", "output": "e"}, "own", "train")["rows"] == 2
    c = spark.createDataFrame([("d", "a", "a"), ("d", "a", None), ("d", "b", "a")], "d string, gold string, pred string")
    assert [(r["gold"], r["pred"], r["n"]) for r in sinks.confusion_long(c, ["d"], ["a", "b"]).orderBy("place").collect()] == [("a", "a", 1), ("a", "b", 0), ("a", "__invalid__", 1), ("b", "a", 1), ("b", "b", 0), ("b", "__invalid__", 0)]
    text = sinks.report_sections("t", {"one": "words", "two": c})
    assert text.startswith("# t\n\n## one\n\nwords\n\n## two\n\n| d | gold | pred |") and text.count("\n| d |") == 4


def _samples(tmp_path) -> dict[str, str]:
    """Small files in the shapes a delivery has."""
    ret = "raw_return_{0},benchmark_return_{0},abnormal_return_{0}"
    slugs = ",".join(ret.format(w) for w in ("w_p0_p1", "w_p0_p3", "w_p0_p5", "w_m1_p1"))
    heads = {
        "events": "event_id,event_date,gvkey,cusip,ticker,label_direction,label_magnitude,headline", "daily": "permno,date,ret,prc,shrout,vol", "link": "gvkey,permno,linktype,linkprim,linkdt,linkenddt", "benchmark": "date,benchmark_return",
        "panel": "event_id,event_date,gvkey,cusip,ticker,permno,label_direction,label_magnitude,join_key_type,join_status", "windows": f"event_id,event_date,permno,gold_direction_label,adapter_1k_direction_label,{slugs}",
        "named": "PERMNO,trading_date,return,price,shares_outstanding,volume,ncusip",
    }
    return {k: put(tmp_path / f"{k}.csv", h + "\n" + ",".join("1" for _ in h.split(",")) + "\n") for k, h in heads.items()}


def test_checks_of_deliveries(spark, tmp_path):
    from skarn.sources import checks

    f = _samples(tmp_path)
    ok = checks.check_market_data(spark, f["daily"], f["link"], f["benchmark"])
    assert ok.passed and ok.rows[-1][0] == "pass" and ok.table(spark).count() == len(ok.rows)
    assert not checks.check_market_data(spark, f["daily"]).passed and checks.check_market_data(spark, f["named"]).passed and not checks.check_market_data(spark, str(tmp_path / "none.csv"), f["link"]).passed
    found, steps = checks.check_event_panel(spark, f["events"], f["daily"], f["link"], benchmark=f["benchmark"])
    assert found.passed and len(steps) == 1 and steps[0].startswith("gvkey")
    assert not checks.check_event_panel(spark, f["events"], f["daily"])[0].passed
    found, steps = checks.check_event_panel(spark, f["events"], f["named"])
    assert found.passed and steps == ["cusip -> ncusip of the daily file around event_date"] and ("warn", "no link table: fallback identifiers only") in found.rows
    assert not checks.check_event_panel(spark, f["daily"], f["daily"], f["link"])[0].passed
    found, columns = checks.check_event_windows(spark, f["panel"], f["daily"], ["0:1", "-1:1"], f["benchmark"])
    assert found.passed and "raw_return_w_p0_p1" in columns and len(columns) == 6
    assert not checks.check_event_windows(spark, f["panel"], f["daily"], ["5:1"])[0].passed
    found, metrics = checks.check_label_alignment(spark, f["windows"], ["gold_direction_label", "adapter_1k_direction_label", "adapter_10k_direction_label"], ["0:1", "0:3", "0:5", "-1:1"])
    assert found.passed and len(metrics) == 8 and ("gold_direction_label", "abnormal_return_w_m1_p1") in metrics
    assert not checks.check_label_alignment(spark, f["windows"], ["other"], ["0:1"])[0].passed and not checks.check_label_alignment(spark, f["panel"], ["label_direction"], ["0:1"])[0].passed


def test_stages_notice_changed_inputs(spark, tmp_path):
    p = put(tmp_path / "in.csv", "a\n1\n")
    calls = []
    build = lambda: (calls.append(1), spark.read.option("header", True).csv(p))[1]
    for _ in range(2):
        assert sinks.materialise(spark, str(tmp_path / "m"), {}, build, inputs=[p]).count() == 1
    put(tmp_path / "in.csv", "a\n1\n22\n")
    assert sinks.materialise(spark, str(tmp_path / "m"), {}, build, inputs=[p]).count() == 2 and len(calls) == 2


def test_jsonl_examples(spark, tmp_path):
    lines = [{"instruction": "i", "output": "it is Positive", "id": "x1"}, {"instruction": "j", "input": "z", "output": '{"direction": "negative"}'}]
    p = put(tmp_path / "e.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n")
    got = {r["instruction"]: r for r in readers.read_eval_examples(spark, p, "ds").collect()}
    assert (got["i"]["example_id"], got["i"]["target_label"], got["i"]["task_type"], got["i"]["input"]) == ("x1", "positive", "classification", "")
    assert got["j"]["target_label"] == "negative" and got["j"]["task_type"] == "structured" and got["j"]["example_id"].startswith("ds-")
    with pytest.raises(contracts.ContractError, match="output"):
        readers.read_jsonl(spark, put(tmp_path / "f.jsonl", '{"instruction": "a"}\n'), "instruction string, input string, output string", ["instruction", "output"])
    with pytest.raises(contracts.ContractError, match="no records"):
        readers.read_jsonl(spark, put(tmp_path / "g.jsonl", ""), "a string", ["a"])
    assert readers.read_jsonl(spark, p, "instruction string, input string", defaults={"input": ""}).where("input = ''").count() == 1


def test_metrics_and_filings(spark, tmp_path):
    p = put(tmp_path / "m.json", json.dumps({"tasks": {"t": {"plain": {"base": {"accuracy": 0.5, "macro_f1": 0.25, "confusion": {"a->b": 1}}}}}}))
    got = {r["metric"]: r["value"] for r in readers.read_metrics_json(spark, p, ["accuracy", "macro_f1", "gone"]).collect()}
    assert got == {"accuracy": 0.5, "macro_f1": 0.25}
    recent = {k: [f"{k}{i}" for i in range(3)] for k in ("filingDate", "acceptanceDateTime", "primaryDocument", "primaryDocDescription")} | {"accessionNumber": ["1-2-3", "4-5-6", "7-8-9"], "form": ["8-K", "10-Q", "8-K"]}
    df = spark.createDataFrame([("320", json.dumps({"filings": {"recent": recent}}))], "cik string, s string")
    rows = readers.filing_rows(df, "s", "8-K").orderBy("place").collect()
    assert [r["accession_number"] for r in rows] == ["123", "789"] and rows[0]["cik"] == "0000000320" and rows[1]["filing_url"].endswith("/320/789/primaryDocument2")
    assert readers.filing_rows(df, "s", "8-K", 1).count() == 1


def test_contracts():
    found, missing = contracts.resolve_aliases(["Trading_Date", "PERMNO", "permno"], contracts.DAILY_ALIASES)
    assert found["date"] == "Trading_Date" and found["permno"] == "permno" and "ret" in missing
    assert contracts.join_plan(["gvkey", "ticker"], True, ["permno"]) == "gvkey" and contracts.join_plan(["gvkey", "ticker"], False, ["ticker_norm"]) == "ticker"
    with pytest.raises(contracts.ContractError):
        contracts.join_plan(["gvkey"], False, ["permno"])
    assert contracts.window_columns(["0:1"], ["raw_return"]) == ["raw_return_w_p0_p1"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "b int, a string")
    assert sinks.write_jsonl(df, str(tmp_path / "j")) == 2 and sinks.write_parquet(df, str(tmp_path / "p")) == 2
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect())
    assert lines == ['{"a":"é","b":2}', '{"a":null,"b":1}']
    assert json.loads(sinks.report_json(df.where("b = 1"))) == {"a": None, "b": 1}
    assert "| 2 | é |" in sinks.report_markdown(df, "t")
    calls = []
    build = lambda: (calls.append(1), df)[1]
    for conf in ({"x": 1}, {"x": 1}, {"x": 2}):
        sinks.materialise(spark, str(tmp_path / "m"), conf, build)
    assert len(calls) == 2
    assert sinks.human_size(2048) == "2.0 KB"


def _raw(tmp_path):
    head = ",".join(contracts.ESTIMATE_COLUMNS)
    base = {"CUSIP": "12345678X", "OFTIC": " abc ", "TICKER": "abc", "CNAME": "Abc", "FPI": "1", "MEASURE": "eps", "USFIRM": "1", "FPEDATS": "2024-12-31", "CURRFL": "", "report_curr": "", "REVTIMS": "10:00:00"}
    rows = [
        {"ESTIMATOR": "e1", "ANALYS": "a1", "VALUE": "1.0", "REVDATS": "2024-01-02"}, {"ESTIMATOR": "e1", "ANALYS": "a1", "VALUE": "1.0", "REVDATS": "2024-01-02", "PDF": "P"},
        {"ESTIMATOR": "e2", "ANALYS": "a2", "VALUE": "2.0", "REVDATS": "2024-01-02"}, {"ESTIMATOR": "e1", "ANALYS": "a1", "VALUE": "1.5", "REVDATS": "2024-01-10"},
        {"ESTIMATOR": "e1", "ANALYS": "a1", "VALUE": "n/a", "REVDATS": "2024-01-11"}, {"ESTIMATOR": "e1", "ANALYS": "a1", "VALUE": "3", "REVDATS": "bad", "ANNDATS": "2024-01-20"},
        {"ESTIMATOR": "e1", "ANALYS": "a1", "VALUE": "3", "REVDATS": "2024-01-12", "USFIRM": "0"}, {"ESTIMATOR": "e1", "ANALYS": "a1", "VALUE": "3", "REVDATS": "2024-01-12", "report_curr": "eur"},
    ]
    text = "\n".join([head, *[",".join((base | r).get(c, "") for c in contracts.ESTIMATE_COLUMNS) for r in rows]])
    return put(tmp_path / "est.csv", text + "\n")


def test_pipeline(spark, tmp_path):
    daily = put(tmp_path / "d.csv", "PERMNO,date,CUSIP,NCUSIP,TICKER,COMNAM,PRC,VOL,RET,SHROUT\n7,2024-01-10,12345678,12345678,ABC,Abc,-5,1,0.10,1\n7,2024-01-11,12345678,12345678,ABC,Abc,5,1,C,1\n7,2024-01-12,12345678,12345678,ABC,Abc,5,1,0.10,1\n")
    bench = put(tmp_path / "b.csv", "DATE,vwretd\n2024-01-10,0.01\n2024-01-12,0.01\n")
    cfg = pipeline.PipelineConfig(_raw(tmp_path), str(tmp_path / "out"), daily, bench)
    rec = pipeline.run(spark, cfg)
    assert spark.read.parquet(f"{cfg.out}/silver").count() == 4
    gold = spark.read.parquet(f"{cfg.out}/gold").orderBy("event_date").collect()
    assert [(r["consensus_median"], r["direction_label"]) for r in gold] == [(1.0, "neutral"), (1.5, "positive"), (3.0, "positive")]
    p = {r["event_id"]: r for r in spark.read.parquet(f"{cfg.out}/panel").collect()}
    a = p["ABC|2024-01-10|1|2024-12-31"]
    assert a["security"] == 7 and a["join_method"] == "cusip8" and a["raw_return_w_p0_p1"] == pytest.approx(0.21) and a["abnormal_return_w_p0_p1"] == pytest.approx(0.21 - 0.0201) and a["alignment_label"] == "aligned"
    b = p["ABC|2024-01-20|1|2024-12-31"]
    assert b["join_status"] == "unmatched" and b["obs_count_w_p0_p1"] == 0 and b["alignment_label"] == "unobserved"
    assert rec.count() == 2 and json.loads(rec.first()["input"])["company"]["oftic"] == "ABC"
    msgs = rec.withColumn("m", F.array(F.struct(F.lit("assistant").alias("role"), F.col("output").alias("content"))))
    assert record_errors(msgs, "event_id", F.col("input"), F.col("output"), F.col("m"), ["direction_label", "magnitude_bucket"]).count() == 0
    with pytest.raises(ValueError):
        pipeline.run(spark, cfg, "gold", "bronze")


def test_chat_stage_validation_and_settings(spark, tmp_path):
    bench = put(tmp_path / "b.csv", "DATE,ewretd,vwretd,sprtrn\n2024-01-10,9,0.01,9\n2024-01-10,9,0.01,9\n2024-01-12,9,,9\n")
    assert [tuple(r) for r in pipeline.benchmark_bronze(spark.read.option("header", True).csv(bench)).select("benchmark_return").collect()] == [(0.01,)]
    with pytest.raises(contracts.ContractError, match="return"):
        pipeline.benchmark_bronze(spark.read.option("header", True).csv(bench), "other")
    text = f"pipeline:\n  estimates: {_raw(tmp_path)}\n  out: {tmp_path / 'out'}\n  windows: ['0:1', '-1:1']\n  train_eval: 1\n  sample: 1\n  train_fraction: 0.4\n  validation_fraction: 0.3\n"
    cfg = pipeline.PipelineConfig.read(spark, put(tmp_path / "c.yaml", text))
    assert cfg.windows == ("0:1", "-1:1") and cfg.train_fraction == 0.4 and cfg.seed == 42
    with pytest.raises(contracts.ContractError, match="unknown"):
        pipeline.PipelineConfig.read(spark, put(tmp_path / "d.yaml", "pipeline:\n  estimate: x\n"))
    assert pipeline.run(spark, cfg, through="validation").count() == 0
    c = spark.read.parquet(f"{cfg.out}/chats").collect()
    assert sorted(r["split"] for r in c) == ["sample_100", "test", "train"]
    m = c[0]["messages"]
    assert [x["role"] for x in m] == ["system", "user", "assistant"] and m[2]["content"] == c[0]["output"] and set(json.loads(c[0]["output"])) == set(pipeline.ANSWER_KEYS)
    payload = json.loads(c[0]["input"])
    assert payload["event"]["join_status"] == "unmatched" and "raw_return_w_p0_p1" in payload["features"] and "raw_return_w_m1_p1" not in payload["features"]
    twice = spark.createDataFrame(c, spark.read.parquet(f"{cfg.out}/chats").schema).where("split = 'train'")
    twice = twice.unionByName(twice.withColumns({"split": F.lit("test"), "output": F.lit("{}")}))
    assert {(r["split"], r["error"]) for r in pipeline.validation(twice).collect()} == {("test", "output mismatch"), ("test,train", "stands in several splits")}


def test_panel_resolves_through_the_stock_header(spark, tmp_path):
    daily = put(tmp_path / "d.csv", "PERMNO,date,CUSIP,NCUSIP,TICKER,COMNAM,PRC,VOL,RET,SHROUT\n" + "".join(f"{p},2024-01-{d},,{n},{t},X,5,1,0.10,1\n" for p, n, t in ((7, "", ""), (8, "", ""), (9, "99999999", "")) for d in (10, 11)))
    header = put(tmp_path / "h.csv", "PERMNO,PERMCO,HTSYMBOL,HTICK,HCOMNAM,CUSIP,BEGDAT,ENDDAT,HNAICS,HSICCD,HPRIMEXC\n7,1,,,X,12345678,2024-01-10,2024-01-10,,,\n7,1,OLD,,X,12345678,2020-01-01,2023-12-31,,,\n8,1, ,tic,X,,2024-01-01,,,,\n9,1,,,X,12345678,2019-01-01,2024-01-09,,,\n9,1,NEW,,X,99999999,2024-01-01,,,,\n")
    ids = [("both", "12345678", "TIC"), ("ticker", "00000000", "TIC"), ("expired", None, "OLD"), ("direct", "99999999", "TIC"), ("none", None, None)]
    rows = [(e, c, o, "2024-01-10", 1.0, "T", "N", "EPS", "USD", "positive") for e, c, o in ids]
    g = spark.createDataFrame(rows, "event_id string, cusip8 string, oftic_norm string, event_date string, prior_consensus_median double, ticker_norm string, company_name_norm string, measure_norm string, report_currency_norm string, direction_label string").withColumn("event_date", F.to_date("event_date"))
    read = lambda f: spark.read.option("header", True).csv(f)
    p = pipeline.panel(g, pipeline.daily_silver(read(daily)), None, pipeline.PipelineConfig("", ""), pipeline.header_silver(read(header)))
    got = {r["event_id"]: (r["security"], r["join_method"], r["join_confidence"], r["realized_direction_label"]) for r in p.collect()}
    assert got == {"both": (7, "cusip8_header", 0.7, "positive"), "ticker": (8, "ticker_header", 0.6, "positive"), "expired": (None, "none", 0.0, "unknown"), "direct": (9, "ncusip8", 0.9, "positive"), "none": (None, "none", 0.0, "unknown")}


def test_bundle_lookup_and_doctor(spark, tmp_path):
    from skarn.operators.profile import dataset_card
    from skarn.operators.resolve import lookup
    from skarn.session import doctor

    df = spark.createDataFrame([("a", "x", "s1"), ("b", "x", "s1"), (None, "y", "s2")], "k string, text string, sig string")
    card = dataset_card(df, ["k"], F.col("sig"), "text")
    assert {(r["section"], r["name"]): r["value"] for r in card.collect()}["all", "duplicate_rate"] == 0.3333
    assert sinks.write_bundle(df, card, str(tmp_path / "b"), ("sig",)) == 3
    assert "sig" not in json.loads(spark.read.text(str(tmp_path / "b/records")).first()[0])
    dim = spark.createDataFrame([("a", 1)], "k string, n int")
    assert sorted(r["n"] or 0 for r in lookup(df, dim, "k").collect()) == [0, 0, 1]
    with pytest.raises(KeyError, match="b"):
        lookup(df, dim, "k", required=True)
    assert doctor(spark)["works"]
