"""Validators, decisions, redaction, chat text, SQL functions, sinks."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import policy, sqlfuncs, validators
from maskwright.functions import text as X
from maskwright.operators import scan as S
from maskwright.sources import files, sinks

VALID = {
    "iban": (
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "de89370400440532013000", "GB82WEST12345698765432", "FR7630006000011234567890189"],
        ["DE89370400440532013001", "DE89", ""],
    ),
    "card": (["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"], ["4111111111111112", "411111", ""]),
    "bsn": (["123456782"], ["501442600"]),
    "cpr": (["311280-0008"], ["321280-0008"]),
    "personnummer": (["850101-1236", "19850101-1236"], ["850101-1235"]),
    "cnp": (["1800101221128", "1800101221144"], ["1800101221145"]),
    "phone": (["+45 12345678", "(555) 123-4567"], ["1234", "1234567890123456"]),
    "email_format": (["a@b.co"], ["a b@c.d", "nope", "a@b"]),
}


@pytest.mark.parametrize("name", sorted(VALID))
def test_validators(spark, name):
    good, bad = VALID[name]
    df = spark.createDataFrame([(v, True) for v in good] + [(v, False) for v in bad], "v string, want boolean")
    for r in df.select("v", "want", validators.column(name, "v").alias("got")).collect():
        assert r.got == r.want, r


def scan_one(spark, text, **kw):
    df = spark.createDataFrame([(text, kw.pop("terms_value", None))], "text string, terms array<string>")
    return S.scan(df, **kw).first()


def test_scan_of_mixed_text(spark):
    r = scan_one(spark, "IBAN DE89370400440532013000, card 4111-1111-1111-1111, mail a@b.com")
    assert r.redacted == "IBAN [IBAN], card [CARD], mail [EMAIL]"
    assert r.detected_types == ["IBAN", "CREDIT_CARD", "EMAIL"] and r.action == "BLOCK" and not r.clean


def test_redaction_modes(spark):
    assert scan_one(spark, "x a@b.com", mode="blank").redacted == "x ████████"
    assert re.fullmatch(r"x \[EMAIL:[0-9a-f]{8}\] y", scan_one(spark, "x a@b.com y", mode="hash").redacted)


def test_overlapping_terms_do_not_corrupt(spark):
    r = scan_one(spark, "mail john@test.com", terms="terms", terms_value=["john@test", "mail"])
    assert [m.type for m in r.matches] == ["CUSTOM_TERM", "EMAIL", "CUSTOM_TERM"]  # merged, not re-resolved
    assert r.redacted == "[REDACTED] [EMAIL]"


def test_action_rules(spark):
    df = spark.createDataFrame([(["EMAIL", "IBAN"],), (["EMAIL"],), (["UNKNOWN"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(policy.action_of(F.col("t"))).collect()] == ["BLOCK", "WARN", "ALLOW", "ALLOW"]
    own = policy.rule_map({"EMAIL": "BLOCK"})  # replaces the defaults as a whole
    assert [r[0] for r in df.select(policy.action_of(F.col("t"), own)).collect()] == ["BLOCK", "BLOCK", "ALLOW", "ALLOW"]


def test_client_action_switches(spark):
    df = spark.createDataFrame([(["IBAN", "CUSTOM_TERM"],), (["IBAN"],)], "t array<string>")
    rules = policy.rule_map({"IBAN": "BLOCK"})
    on = [tuple(r[0]) for r in df.select(policy.action_client(F.col("t"), rules)).collect()]
    off = [tuple(r[0]) for r in df.select(policy.action_client(F.col("t"), rules, enable_block=False)).collect()]
    assert on == [("BLOCK", ["IBAN"]), ("BLOCK", ["IBAN"])]
    assert off == [("WARN", ["CUSTOM_TERM"]), ("ALLOW", [])]


def test_rule_triggers(spark):
    rules = F.expr("array(named_struct('ord',1,'id','R1','triggers',array('EMAIL','PHONE','IBAN'),'action','WARN'))")
    df = spark.createDataFrame([(["IBAN"],), ([],), (["UNKNOWN"],)], "h array<string>")
    got = [r[0] for r in df.select(policy.rule_triggers(F.col("h"), rules)["id"]).collect()]
    assert got == ["R1", None, None]


def test_hosts(spark):
    df = spark.createDataFrame([("claude.ai",), ("chatgpt.com",), ("google.com",), ("sub.claude.ai",), ("",)], "h string")
    assert [r[0] for r in df.select(policy.is_ai_domain(F.col("h"))).collect()] == [True, True, False, False, False]


def test_clean_terms_order(spark):
    df = spark.createDataFrame([([" ", None, "  a  "] + [f"t{i}" for i in range(60)] + ["x" * 200],)], "t array<string>")
    terms = df.select(policy.clean_terms(F.col("t"))).first()[0]
    assert terms[0] == "a" and len(terms) == 50


def test_chat_bodies(spark):
    rows = [
        ('{"messages":[{"content":"x"},{"content":[{"type":"text","text":"mail"},{"type":"image_url"}]}]}', "x\nmail", "x\nmail", "x"),
        ('{"prompt":["a","b",3],"input":"z"}', "a\nb\nz", "", "z"),
        ('{"system":[{"type":"text","text":"s"}],"messages":[{"content":"q"}]}', "q", "s\nq", "q"),
        ("not json", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "body string, o string, a string, s string")
    got = df.select("o", "a", "s", X.chat_text_openai("body").alias("o2"), X.chat_text_anthropic("body").alias("a2"), X.chat_text_sdk("body").alias("s2"))
    for r in got.collect():
        assert (r.o, r.a, r.s) == (r.o2, r.a2, r.s2)


def test_long_conversations_come_out_whole_in_parts(spark):
    long = [(3, i, "w" * 999) for i in range(1200)]
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (1, 2, None), (2, 0, "x" * 50), *long], "conv_id long, turn long, text string")
    small = {(r.conv_id, r.part): r for r in X.conversation_text(df.where("conv_id < 3"), part_chars=20).collect()}
    assert small[1, 0].text == "a\nb" and small[1, 0].n_turns == 3
    assert small[2, 0].text == "x" * 50 and small[2, 0].n_chars == 50
    parts = X.conversation_text(df.where("conv_id = 3"), slot=100).orderBy("part").collect()
    assert [p.part for p in parts] == [0, 1, 2] and sum(p.n_turns for p in parts) == 1200
    assert "\n".join(p.text for p in parts) == "\n".join(["w" * 999] * 1200)


def test_stored_terms_are_all_used_and_no_tenant_is_lost(spark):
    terms = ["zz%02d" % i for i in range(60)] + [" "]
    config = spark.createDataFrame([(1, "finance", json.dumps(terms))], "org_id long, preset string, custom_terms string")
    texts = spark.createDataFrame([(1, "see zz59"), (2, "mail a@b.com"), (None, "zz59")], "org_id long, text string")
    rows = {r.org_id: r for r in S.scan(policy.with_tenant_policy(texts, config), terms="terms", rules="rules", redact=False).collect()}
    assert len(rows[1].terms) == 60 and rows[1].detected_types == ["CUSTOM_TERM"] and rows[1].action == "WARN"
    assert rows[2].action == "WARN" and rows[None].action == "ALLOW"


def test_over_size_text_is_an_error_only(spark):
    texts = spark.createDataFrame([("s", "mail a@b.com " + "x" * 500_000), ("s", "fine")], "source string, text string")
    r = S.corpus_summary(S.scan(texts), ["source"]).first()
    assert (r.total, r.errors, r.warned, r.blocked, r.allowed, r.matches) == (2, 1, 0, 0, 1, 0) and r.fail_block


def test_scan_deals_rows_out_only_where_asked(spark, sf):
    from maskwright.session import SPREAD
    from maskwright.sources.golden import seeded

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = lambda: S.scan(seeded(docs))._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobin" in plan()
    asked = spark.conf.get(SPREAD)
    spark.conf.unset(SPREAD)
    try:
        assert "Exchange" not in plan()
    finally:
        spark.conf.set(SPREAD, asked)


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in {"a.TXT": b"mail a@b.com", "sub/b.md": b"ok", "sub/c.pdf": b"x\xffy a@b.com", "d.xlsx": b"a@b.com", "e.exe": b"a@b.com"}.items():
        (tmp_path / name).write_bytes(body)
    listed = {os.path.basename(r.path) for r in files.supported_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.TXT", "b.md", "c.pdf", "d.xlsx"}
    got = {os.path.basename(r.path): r for r in S.scan(files.read_files(spark, str(tmp_path))).collect()}
    limited = {os.path.basename(r.path): r.error_code for r in files.read_files(spark, str(tmp_path), max_bytes=4).collect()}
    assert limited == {"a.TXT": "FILE_TOO_LARGE", "b.md": None, "c.pdf": "FILE_TOO_LARGE", "d.xlsx": "FILE_TOO_LARGE"}
    assert got["a.TXT"].action == "WARN" and got["c.pdf"].action == "WARN"
    assert got["b.md"].clean and got["d.xlsx"].clean  # spreadsheets have no fallback text


class Unopened:
    """Of a store that Arrow does not know."""

    @staticmethod
    def from_uri(uri):
        raise files.pa.ArrowInvalid(uri)


@pytest.mark.parametrize("store", ["arrow", "spark"])
def test_one_file_a_key_in_few_folders(spark, tmp_path, monkeypatch, store):
    """Rows of a key are lines of one file; folders and reading tasks do not grow with the files."""
    if store == "spark":
        monkeypatch.setattr(files, "FileSystem", Unopened)
    else:
        monkeypatch.setattr(files, "FOLDERS", 7)
        monkeypatch.setattr(files, "LEAST_TASKS", 5)
        monkeypatch.setattr(files, "TASKS_A_CORE", 0)
    root = str(tmp_path / "files")
    rows = [(i, f"mail a{i}@b.com é") for i in range(60)] + [(7, "again"), (-3, ""), (8, None), (None, "x"), (None, "y")]
    files.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), root, "doc_id")
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(f"{v or ''}\n")
    read = files.read_files(spark, root)
    got = {r.k: r.text for r in read.select(files.key_of(F.col("path"), "doc_id").alias("k"), "text").collect()}
    assert read.count() == len(want) == len(got)
    assert {k: sorted(v.splitlines(True)) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    if store == "arrow":
        assert len(os.listdir(root)) <= 7 and read.rdd.getNumPartitions() <= 5


def test_files_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no file's name; names, hidden and empty files, links and times are taken as Spark takes them."""
    root = tmp_path / "a b%20c"
    odd = ["x y%20.txt", "é#.txt", "_a.txt", "_a=.txt", ".b.txt", "c.txt._COPYING_", "_metadata.txt", "n.log"]
    for name in odd + ["_h/1.txt", ".q/1.txt", "_k=1/1.md", "_metadata/1.txt", "_metadata/_metadata", "s/t/u/1.TXT", "s/t/2.txt", "s/e.txt"]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("" if name == "s/e.txt" else f"mail é{name}@b.com")
    os.symlink(root / "s", root / "linked")
    os.symlink(root / "nowhere", root / "broken.txt")
    want = files._binary(spark, str(root))
    for asked in (str(root), f"file://{root}/"):
        assert files.read_files(spark, asked).inputFiles() == files.supported_files(spark, asked).inputFiles() == []
        listed, loaded = files._listed(spark, asked)
        for got, columns in ((listed, ["path", "modificationTime", "length"]), (loaded(listed), ["path", "length", "content"])):
            assert sorted(got.select(columns).collect()) == sorted(want.select(columns).collect())
    assert want.count() == 10
    one = files.read_files(spark, str(root / "s/t/2.txt")), files.read_files(spark, str(root / "s/t/*.txt").replace("%20", "?20"))
    assert [[r.text for r in x.collect()] for x in one] == [["mail és/t/2.txt@b.com"]] * 2


def test_files_of_many_batches(spark, tmp_path, monkeypatch):
    """Each file comes with its own text, wherever an Arrow batch ends; few tasks read few files."""
    monkeypatch.setattr(files, "BATCH_BYTES", 100)
    monkeypatch.setattr(files, "BATCH_FILES", 4)
    for i in range(150):
        (tmp_path / f"{i}.txt").write_text(f"{i} " * (200 if i % 9 == 0 else 1 + i % 7))
    read = files.read_files(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() <= 8
    got = {os.path.basename(r.path): (r.text, r.length) for r in read.collect()}
    assert got == {f"{i}.txt": (t := f"{i} " * (200 if i % 9 == 0 else 1 + i % 7), len(t)) for i in range(150)}


def test_written_texts_are_not_shuffled(spark, tmp_path):
    """Names of parts are; rows of a key meet in its file from whichever tasks and batches, and no part is left."""
    texts = {i: [f"{i} {j} " + "".join(random.Random(7 * i + j).choices("abcdefgh", k=9_000)) for j in range(1 + 4 * (i == 3))] for i in range(60)}
    rows = spark.createDataFrame([(k, v) for k, vs in texts.items() for v in vs], "doc_id long, text string").repartition(5)
    rows.write.parquet(str(tmp_path / "rows"))
    disk, listed = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    shuffled = lambda: {f.getName(): f.length() for f in listed(disk.getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffled()
    files.write_files(spark.read.parquet(str(tmp_path / "rows")), str(tmp_path / "files"), "doc_id")
    assert sum(n for name, n in shuffled().items() if name not in before) < 60_000
    got = {p.name: sorted(p.read_text().splitlines()) for p in (tmp_path / "files").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert got == {f"doc_id={k}.txt": sorted(vs) for k, vs in texts.items()}


def test_a_file_is_settled_again(tmp_path):
    """A task that runs again finds some parts gone: its file is kept. Without the file, that is an error."""
    store, path = files.FileSystem.from_uri(str(tmp_path))[0], str(tmp_path / "k=1.txt")
    for n, left in ((1, 0), (3, 0), (3, 2)):
        parts = [str(tmp_path / f"_{n}{left}{i}") for i in range(n)]
        for part in parts:
            open(part, "w").write(part[-1])
        files._settle(store, path, parts)
        for part in parts[n - left :]:
            open(part, "w").write("again")
        files._settle(store, path, parts)
        assert open(path).read() == "012"[:n]
    os.remove(path)
    with pytest.raises(FileNotFoundError):
        files._settle(store, path, parts)


def test_scan_of_a_folder_with_odd_rows(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(0, None), (1, "a"), (1, "a"), (None, "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = entry.queries()["dir_scan"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.detected_types, r.match_count) for r in got} == {0: ("EMAIL", 1), 1: ("PHONE", 2), None: ("", 0)}


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    r = spark.sql("SELECT iban_valid('DE89370400440532013000') v, redact_tag(t, detect(t)) r, action_of(detected_types(detect(t))) a FROM VALUES ('to a@b.com') x(t)").first()
    assert (r.v, r.r, r.a) == (True, "to [EMAIL]", "WARN")
    long = spark.sql("SELECT e.* FROM (SELECT detect(t) m FROM VALUES ('a@b.com c@d.com') x(t)) d, LATERAL explode_matches(d.m) e").collect()
    assert [(m.type, m.start) for m in long] == [("EMAIL", 0), ("EMAIL", 8)]


def test_logs_never_hold_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "mail a@b.com")], "doc_id long, text string")
    log = sinks.metadata_log(S.scan(df), ["doc_id"], "2024-01-31 00:00:00")
    assert not sinks.FORBIDDEN & set(log.columns)
    sinks.append_log(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 1 and "a@b.com" not in str(back.first())
    with pytest.raises(ValueError):
        sinks.append_log(S.scan(df).withColumn("timestamp", F.current_timestamp()), str(tmp_path / "bad"))


def test_scan_adds_no_shuffle_and_extracts_once(spark):
    df = spark.range(10).selectExpr("id AS doc_id", "concat('x a@b.com ', id) AS text")
    plan = S.scan(df).filter("action = 'BLOCK'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert plan.count("ghp_[a-zA-Z0-9]") == 2  # one extraction, one split


@pytest.mark.parametrize("n", [1, 255, 256, 257, 512, 513, 3000])
def test_block_edges(spark, n):
    """Folds run in blocks of spans; every count around a block edge must give the same result."""
    text = "".join(f"é {i} a{i}@b.co, widget; " for i in range(n))
    r = scan_one(spark, text, terms="terms", terms_value=["widget"], types=["EMAIL"])
    mails = [m for m in r.matches if m.type == "EMAIL"]
    assert len(mails) == n and len(r.matches) == 2 * n
    assert all(text[m.start : m.end] == m.value for m in r.matches)
    assert r.redacted == "".join(f"é {i} [EMAIL], [REDACTED]; " for i in range(n))
