"""Contracts, privacy, enrichment and small column rules."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom.config import EngineConfig
from eventloom.functions.contracts import contract_outcome
from eventloom.functions.device import browser, device_type, operating_system
from eventloom.functions.keys import next_retry_at, partition_key, partition_of, route_topic
from eventloom.functions.privacy import mask_email, mask_phone, pii_hash
from eventloom.functions.text import has_text, properties_json
from eventloom.functions.times import epoch_ms_to_ts, idle_expired, sweep_due
from eventloom.operators.contracts import check_contracts
from eventloom.operators.enrich import default_times, flatten_enrich, sink_defaults, stamp_app
from eventloom.operators.privacy import apply_privacy
from eventloom.operators.validate import reject_record, split_identify, split_required
from eventloom.schemas import EVENT_COLUMNS, RAW_EVENT
from eventloom.sources.contracts import explode_contracts, parse_contracts
from eventloom.workspace import prepare_session

CFG = EngineConfig()


def now():
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def one(spark, value, rule, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(rule(F.col("v")).alias("r")).first().r


# ------------------------------------------------------------------ contracts

FIELDS = [
    {"name": "orderId", "type": "string", "required": True},
    {"name": "amount", "type": "number", "required": True},
    {"name": "coupon", "type": "string", "required": False},
]


def violations(spark, custom, event_type="purchase", fields=FIELDS, mode="enforce"):
    text = json.dumps({"appId": "app1", "version": 3, "events": {"purchase": {"fields": fields}, "page_view": {"fields": []}}})
    contracts = parse_contracts(spark.createDataFrame([("app1", text)], "app_code string, contract_json string"))
    events = spark.createDataFrame([("e", event_type, "app1", custom)], "event_id string, event_type string, app_code string, custom string")
    row = check_contracts(events, contracts, CFG.with_(contract_mode=mode)).first()
    return row.violations, row.contract_outcome


@pytest.mark.parametrize(
    "custom,event_type,expected",
    [
        ('{"orderId":"O1","amount":9.9}', "purchase", []),
        ("{}", "ghost", ["unknown event type (schema drift): ghost"]),
        ('{"orderId":"O1"}', "purchase", ["missing required field: amount"]),
        ('{"orderId":"O1","amount":"NaN"}', "purchase", ["field 'amount' expected number but got string"]),
        ('{"orderId":"O1","amount":1}', "purchase", []),
        ('{"orderId":"O1","amount":1,"coupon":null}', "purchase", []),
        (None, "page_view", []),
        (None, "purchase", ["missing required field: orderId", "missing required field: amount"]),
        ("{bad", "purchase", ["missing required field: orderId", "missing required field: amount"]),
    ],
)
def test_violations(spark, custom, event_type, expected):
    assert violations(spark, custom, event_type)[0] == expected


def test_types_by_json_kind(spark):
    kinds = ("string", "number", "integer", "boolean", "object", "array", "INTEGER", "date", None)
    values = {"s": "x", "f": 1.5, "w": 2.0, "i": 7, "b": True, "o": {"a": 1}, "l": [1]}
    fits = {
        "string": "s", "number": "fwi", "integer": "wi", "boolean": "b", "object": "o", "array": "l",
        "INTEGER": "wi", "date": "sfwibol", None: "sfwibol",
    }
    fields = [{"name": name, "type": kind, "required": True} for kind in kinds for name in values]
    found, _ = violations(spark, json.dumps(values), fields=fields)
    expected = [(name, kind) for kind in kinds for name in values if name not in fits[kind]]
    assert [tuple(v.replace("'", "").split(" ")[1:4:2]) for v in found] == expected


def test_modes(spark):
    broken = '{"orderId":"O1"}'
    assert violations(spark, broken, mode="off") == ([], "PASS")
    assert violations(spark, broken, mode="monitor")[1] == "VIOLATION_MONITOR"
    assert violations(spark, broken, mode="enforce")[1] == "VIOLATION_ENFORCE"
    assert one(spark, ["x"], lambda c: contract_outcome("off", c), "array<string>") == "PASS"
    with pytest.raises(ValueError):
        EngineConfig(contract_mode="strict")


def test_no_contract_cases(spark):
    published = spark.createDataFrame(
        [("a", None), ("b", "{not json"), ("  ", '{"appId":"x"}'), ("c", '{"appId":"c","version":1,"x":{}}'), ("d", " ")],
        "app_code string, contract_json string",
    )
    found = parse_contracts(published)
    assert [(r.app_code, r.events) for r in found.collect()] == [("c", {})]
    flat = parse_contracts(
        spark.createDataFrame([("a", '{"appId":"a","version":2,"events":{"p":{"fields":[{"name":"f"}]}}}')], "app_code string, contract_json string")
    )
    (row,) = explode_contracts(flat).collect()
    assert (row.app_code, row.version, row.event_type, row.fields[0].name) == ("a", 2, "p", "f")


# ------------------------------------------------------------------ privacy


def test_hash_and_masks(spark):
    assert one(spark, "u123", pii_hash) == "h:06c0a1fbb20ef076"
    assert one(spark, "alice@example.com", mask_email) == "a***@example.com"
    assert one(spark, "@example.com", mask_email) == "@example.com"
    assert one(spark, "+1 650-555-1234", mask_phone) == "***1234"
    assert one(spark, "12a", mask_phone) == "***"


def protect(spark, custom, cfg, user="u1", consent=True):
    prepare_session(spark)
    row = spark.createDataFrame([(user, consent, custom)], "user_id string, consent boolean, custom string")
    return apply_privacy(row, cfg).first()


def test_privacy_is_off_by_default(spark):
    row = protect(spark, '{"email":"a@b.com"}', CFG, consent=False)
    assert (row.user_id, row.custom, row.pii_masked, row.consent_denied) == ("u1", '{"email":"a@b.com"}', False, False)


def test_denied_consent_strips_and_does_not_hash(spark):
    cfg = CFG.with_(require_consent=True, hash_user_id=True, pii_fields=("email",), mask_heuristics=True)
    row = protect(spark, '{"email":"a@b.com","page":"/p","mobile":"13800001234"}', cfg, consent=False)
    assert (row.user_id, row.custom) == (None, '{"page":"/p","mobile":"13800001234"}')
    assert (row.pii_masked, row.consent_denied) == (False, True)
    assert protect(spark, "{}", cfg, consent=None).consent_denied is False


def test_hashing(spark):
    row = protect(spark, '{"email":"a@b.com","n":2.0,"z":null}', CFG.with_(hash_user_id=True, pii_fields=("email", "n", "z")))
    custom = json.loads(row.custom)
    assert row.user_id.startswith("h:") and custom["email"].startswith("h:") and custom["z"] is None
    assert custom["n"] == one(spark, "2.0", pii_hash)
    assert row.pii_masked
    assert protect(spark, None, CFG.with_(hash_user_id=True), user=" ").user_id == " "


def test_heuristic_masking(spark):
    cfg = CFG.with_(mask_heuristics=True)
    sent = '{"contact":"bob@x.io","mobile":"13800001234","note":"hello","n":13800001234,"deep":{"e":"bob@x.io"},"tail":"bob@x.io\\n","x":1.0}'
    row = protect(spark, sent, cfg)
    got = json.loads(row.custom)
    assert (got["contact"], got["mobile"], got["note"]) == ("b***@x.io", "***1234", "hello")
    assert (got["n"], got["deep"], got["tail"]) == (13800001234, {"e": "bob@x.io"}, "bob@x.io\n")
    assert '"x":1.0' in row.custom
    same = protect(spark, '{"note": "hello"}', cfg)
    assert (same.custom, same.pii_masked) == ('{"note": "hello"}', False)


def test_rules_rewrite_the_text_in_one_pass(spark):
    """Values of every kind; no structure of new values is built between the text and the text."""
    cfg = CFG.with_(hash_user_id=True, pii_fields=("email",), mask_heuristics=True)
    sent = r'{"email":"a@b.com","to":"x\"y@c.org","tel":"+86 138-0000-1234","n":2.0,"z":null,"o":{"tel":"13800001234"},"t":"q\"","w":13800001234}'
    row = protect(spark, sent, cfg)
    hashed = one(spark, "a@b.com", pii_hash)
    assert row.custom == (
        r'{"email":"%s","to":"x***@c.org","tel":"***1234","n":2.0,"z":null,"o":{"tel":"13800001234"},"t":"q\"","w":13800001234}' % hashed
    )
    assert row.pii_masked
    # a value that is masked already counts as masked, a listed one that is null does not
    assert protect(spark, '{"to":"x***@c.org"}', cfg, user=None).pii_masked
    assert not protect(spark, '{"email":null}', cfg, user=None).pii_masked
    rows = spark.createDataFrame([("u", True, sent)], "user_id string, consent boolean, custom string")
    plan = apply_privacy(rows, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 1


def test_long_stages_are_generated_as_methods_the_jvm_compiles(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    prepare_session(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8_000


def test_repeated_keys_do_not_escape_masking(spark):
    row = protect(spark, '{"a":"bob@x.io","a":"eve@x.io"}', CFG.with_(mask_heuristics=True))
    assert "bob@" not in row.custom and "eve@" not in row.custom


# ------------------------------------------------------------------ enrichment


@pytest.mark.parametrize(
    "agent,expected",
    [
        (None, ("unknown", "unknown", "unknown")),
        ("", ("desktop", "unknown", "unknown")),
        ("Mozilla (Windows NT 10.0) Chrome/120 Safari/537 Edg/120", ("desktop", "Windows", "Edge")),
        ("Mozilla (iPad; CPU OS 17_0 like Mac OS X) Mobile/15E Safari/604", ("mobile", "macOS", "Safari")),
        ("Mozilla (iPad; CPU OS 17_0) Safari/604", ("tablet", "iOS", "Safari")),
        ("Mozilla (Linux; Android 14) Chrome/120 OPR/100", ("mobile", "Linux", "Chrome")),
        ("Chromium/1 Chrome/1", ("desktop", "unknown", "unknown")),
        ("Opera/9 (darwin)", ("desktop", "macOS", "Opera")),
        ("X11 Firefox/1", ("desktop", "unknown", "Firefox")),
    ],
)
def test_user_agents(spark, agent, expected):
    got = tuple(one(spark, agent, rule) for rule in (device_type, operating_system, browser))
    assert got == expected


def test_times_out_of_range_do_not_fail(spark):
    prepare_session(spark)
    got = [one(spark, ms, epoch_ms_to_ts, "long") for ms in (None, 2**63 - 1, -(2**63), 0)]
    assert got[:3] == [None, None, None] and got[3] is not None


RAW_JSON = [
    '{"eventId":"evt_001","eventType":"page_view","userId":"user_123","anonymousId":"anon_456","timestamp":1699000000000,'
    '"page":{"url":"/p","title":"T"},"device":{"screenWidth":1920},"context":{"utmSource":"google","utmMedium":"cpc"},'
    '"data":{"scrollDepth":80,"custom":{"customField":"value","n":42}}}',
    '{"eventId":"evt_002","eventType":"click","timestamp":1699000000001,"clientTime":1699000000000}',
    '{"eventId":" ","eventType":"click","timestamp":1}',
    '{"eventId":"x","eventType":"click"}',
    '{"eventId":"x","eventType":"","timestamp":1}',
]


def raw(spark):
    lines = spark.createDataFrame([(t,) for t in RAW_JSON], "t string")
    return lines.select(F.from_json("t", RAW_EVENT).alias("e")).select("e.*")


def test_flatten_and_store(spark):
    prepare_session(spark)
    first, second, *_ = sorted(flatten_enrich(raw(spark), now()).collect(), key=lambda r: r.event_id or "")[1:]
    assert (first.page_url, first.utm_source, first.scroll_depth) == ("/p", "google", 80)
    assert (first.device_type, first.os, first.browser, first.client_time) == ("unknown", "unknown", "unknown", None)
    assert (second.device_type, second.page_url, second.screen_width) == (None, None, None)
    stored = sink_defaults(default_times(flatten_enrich(raw(spark), now()), now()))
    assert tuple(stored.columns) == EVENT_COLUMNS
    rows = {r.event_id: r for r in stored.collect()}
    assert json.loads(rows["evt_001"].properties) == {"customField": "value", "n": 42}
    assert rows["evt_002"].properties == "{}" and rows["evt_002"].screen_width == 0 and rows["evt_002"].exp_ids == []
    assert rows["evt_001"].client_time == rows["evt_001"].timestamp
    assert rows["evt_002"].scroll_depth is None and rows["evt_002"].user_id == ""


def test_required_fields_and_rejects(spark):
    good, bad = split_required(raw(spark))
    assert good.count() == 2 and bad.count() == 3
    rejected = reject_record(bad, now()).collect()
    assert sum(r.timestamp == r.received_at for r in rejected) == 1
    assert stamp_app(bad, F.lit("app7")).first().app_code == "app7"
    events = spark.createDataFrame([("$identify",), ("click",), (None,)], "event_type string")
    ordinary, control = split_identify(events)
    assert (ordinary.count(), control.count()) == (2, 1)


# ------------------------------------------------------------------ keys and times


def test_keys_and_topics(spark):
    assert one(spark, None, lambda c: partition_key(c, F.lit(None)) ) == "unknown"
    assert one(spark, None, lambda c: partition_key(c, F.lit("a"))) == "a"
    assert one(spark, "", lambda c: partition_of(c, 12)) == 0
    # 'u' * 31 + '1'; a character beyond 16 bits counts as its two halves
    assert one(spark, "u1", lambda c: partition_of(c, 1_000_000)) == 117 * 31 + 49
    assert one(spark, "\U0001f600", lambda c: partition_of(c, 10_000_000)) == 0xD83D * 31 + 0xDE00
    assert one(spark, "polygenelubricants", lambda c: partition_of(c, 12)) == 0  # hash -2^31
    topics = [one(spark, t, lambda c: route_topic(c, CFG)) for t in ("session_start", "session_end", "click")]
    assert topics == ["sessions", "sessions", "events"]


def test_text(spark):
    assert [one(spark, t, has_text) for t in (None, "", " \t", " x ")] == [False, False, False, True]
    assert [one(spark, t, properties_json) for t in (None, "", '{"a":1}')] == ["{}", "{}", '{"a":1}']


def test_idle_borders(spark):
    prepare_session(spark)
    last = F.lit("2024-01-01 00:00:00").cast("timestamp")
    now = F.lit("2024-01-01 00:30:00").cast("timestamp")
    row = spark.range(1).select(idle_expired(last, 1800, now).alias("i"), sweep_due(last, 1800, now).alias("s")).first()
    assert (row.i, row.s) == (False, True)


def test_back_off_doubles_and_stays_near_the_delay(spark):
    rows = spark.range(13).select(
        F.col("id").cast("int").alias("n"), F.unix_seconds(next_retry_at(F.lit("e"), F.col("id").cast("int"), now(), 0.2)).alias("t"),
        F.unix_seconds(now()).alias("now"),
    ).collect()
    for r in rows:
        delay = 2 ** min(r.n, 10)
        assert abs(r.t - r.now - delay) <= delay * 0.1
