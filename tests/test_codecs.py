import datetime
import math
import struct

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tidemark.functions import cbor
from tidemark.functions import series_bytes as codecs
from tidemark.operators import codecs as frames
from tidemark.operators import columns, log_columns, templates
from tidemark.streaming.rollup import stream_rollup


@given(st.lists(st.integers(-(2**63), 2**63 - 1)))
def test_varint(values):
    assert codecs.varint_decode(codecs.varint_encode(np.array(values, np.int64))).tolist() == values


@given(st.lists(st.floats(allow_nan=True, allow_infinity=True)))
def test_xor(values):
    back = codecs.xor_decode(codecs.xor_encode(np.array(values, np.float64)))
    assert struct.pack(f"{len(values)}d", *values) == back.tobytes()


def test_xor_sign_flip_with_all_bits():
    values = [struct.unpack("<d", (1).to_bytes(8, "little"))[0], struct.unpack("<d", (1 << 63).to_bytes(8, "little"))[0], -0.0, 0.0, math.nan]
    assert np.array(values).tobytes() == codecs.xor_decode(codecs.xor_encode(np.array(values))).tobytes()


def test_template_rules():
    cases = {
        "/x-123456 123456 999999": "<PATH> <NUM> <NUM>",
        "081109 203615 148 INFO blk_-123 to /10.0.0.1:50010": "<TIMESTAMP> <NUM> INFO <IDENTIFIER> to <PATH>",
        "[Thu Jun 09 06:07:04 2005] [notice] from 10.1.2.3": "<BRACKET_TIME> [notice] from <IP>",
        "Dec 10 06:55:46 host sshd[12]: literal <NUM>": "<TIMESTAMP> host sshd[<NUM>]: literal <NUM>",
        "hash deadbeef01 and 10001eef 007": "hash <HEX> and 10001eef <NUM>",
        "größe_12 x": "<IDENTIFIER> x",
    }
    for line, template in cases.items():
        got, pieces, kinds, values = templates.scan(line)
        assert got == template, line
        assert "".join(p + v for p, v in zip(pieces, values)) + pieces[-1] == line


VALUES = st.lists(st.floats(allow_nan=True, allow_infinity=True), max_size=80)
PATTERNS = ("constant", "near_constant", "sparse", "power_of_2", "mostly_integers", "exponential", "periodic_6", "periodic_12", "quantized", "quantized_stepped", "smooth", "random")


@given(VALUES, st.sampled_from(PATTERNS))
def test_values_come_back_whatever_the_pattern(values, pattern):
    v = np.array(values, np.float64)
    method, data = codecs.values_encode(v, pattern)
    assert codecs.same(codecs.values_decode(method, data), v)


def test_methods_that_suit():
    rng = np.random.default_rng(0)
    cases = {
        "constant": [1.5] * 50, "near_constant": [1 + 1e-9 * k for k in range(50)], "power_of_2": [2.0 ** (k % 9) for k in range(60)] + [3.0], "mostly_integers": [float(x) for x in rng.integers(0, 10**6, 60)] + [0.5], "exponential": [1.01**k for k in range(60)],
        "periodic": [float(k % 6) + 0.25 for k in range(90)], "dictionary": list(rng.choice([0.1, 0.25, 0.5, 0.9, 7.7], 200)), "sparse": [0.0] * 60 + [3.3, -0.0] + [0.0] * 20, "delta_rle": [5.5] * 200 + [6.25] * 30, "xor": list(rng.standard_normal(100) * 1e6),
    }
    for method, values in cases.items():
        v = np.array(values)
        pattern = "random" if method in ("delta_rle", "xor") else codecs.pattern_of(v)
        got, data = codecs.values_encode(v, pattern)
        assert got == method or (method in ("delta_rle", "xor") and len(data) <= len(codecs.xor_encode(v))), (method, got)
        assert codecs.same(codecs.values_decode(got, data), v)
    for method, encode in (("zero_runs", codecs._zero_runs), ("delta_rle", codecs._delta_rle), ("delta", codecs._delta)):
        v = np.array([1.0, 1.0, 1.0, 2.0, 2.0, 4.0, 4.0])
        assert codecs.same(codecs.values_decode(method, encode(v)), v)
    many = np.arange(600.0).repeat(2)  # more values than a byte can index
    assert codecs.same(codecs._dictionary_back(codecs._dictionary(many)), many)


@given(st.lists(st.integers(-(2**40), 2**40)), st.integers(1, 500))
def test_times(times, step):
    regular = [7 + step * k for k in range(20)]
    dual = [0]
    for k in range(30):
        dual.append(dual[-1] + (step if k % 5 else 2 * step))
    for t in (times, regular, dual, [5] * 9):
        method, data = codecs.times_encode(np.array(t, np.int64))
        assert codecs.times_decode(method, data).tolist() == t
    assert codecs.times_encode(np.array(regular))[0] == "regular" and codecs.times_encode(np.array(dual))[0] == "dual_interval"


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text() | st.binary(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
def test_cbor(value):
    assert list(cbor.loads_all(cbor.dumps(value) * 2)) == [value, value]


def test_cbor_known_bytes():
    for value, known in ((0, "00"), (23, "17"), (24, "1818"), (1000, "1903e8"), (-1, "20"), (1.5, "fb3ff8000000000000"), ("a", "6161"), ([1, [2, 3]], "8201820203"), ({"a": 1}, "a1616101")):  # examples of the standard
        assert cbor.dumps(value).hex() == known


@given(st.lists(st.integers(-(2**62), 2**62) | st.none(), max_size=60), st.lists(st.text(max_size=4), max_size=60), st.lists(st.integers(0, 2**62), max_size=60))
def test_columns(numbers, texts, durations):
    for strategy in ("dictionary", "run_length", "raw"):
        for values in (numbers, texts, [texts, ["a"], texts[:1]]):
            assert columns.decode_column(columns.encode_column(values, strategy), strategy) == values
    whole = [x for x in numbers if x is not None]
    for strategy, values in (("delta", whole), ("power_of_2", durations), ("power_of_2", whole)):
        assert columns.decode_column(columns.encode_column(values, strategy), strategy) == values


def test_strategies():
    assert columns.choose("start_times", list(range(50))) == "delta" and columns.choose("durations", [1 << k % 20 for k in range(50)]) == "power_of_2"
    assert columns.choose("status", [0, 1] * 9) == "dictionary" and columns.choose("service", [f"s{k}" for k in range(50)]) == "run_length" and columns.choose("service", [f"s{k % 11}" for k in range(200)]) == "dictionary"


LOG_TEXTS = st.one_of(st.from_regex(r"[0-9]{1,4}([.][0-9]{1,3}){3}", fullmatch=True), st.from_regex(r"-?[0-9]{1,22}", fullmatch=True), st.from_regex(r"[0-9a-fA-F]{1,12}", fullmatch=True), st.uuids().map(str), st.text(max_size=9), st.from_regex(r"(/[a-z]{0,3}){1,4}", fullmatch=True),
                      st.datetimes(min_value=datetime.datetime(1971, 1, 1), max_value=datetime.datetime(2068, 12, 31)).flatmap(lambda d: st.sampled_from([d.strftime(f) for f in log_columns.TIMES])))


@given(st.lists(LOG_TEXTS, max_size=40))
def test_log_columns(values):
    for kind in (*log_columns.CODECS, "OTHER"):
        data, _ = log_columns.encode_texts(kind, values)
        assert log_columns.decode_texts(kind, data, len(values)) == values


def test_log_columns_keep_what_suits():
    cases = {"IP": (["10.0.0.1", "255.255.255.255"], ["256.1.1.1", "01.2.3.4"]), "NUM": (["0", "-5", "123456789012345678"], ["007", "-0", "1234567890123456789"]), "HEX": (["deadbeef01"], ["abc", "DEADBEEF01"]), "UUID": (["123e4567-e89b-12d3-a456-426614174000"], ["123e4567-e89b-12d3-a456-42661417400g"]),
             "TIMESTAMP": (["2005-06-09T06:07:04", "081109 203615", "Dec 10 06:55:46"], ["2005-13-09T06:07:04", "Dec  1 06:55:46"]), "BRACKET_TIME": (["[Thu Jun 09 06:07:04 2005]"], ["[Fri Jun 09 06:07:04 2005]", "[Thu Jun 9 06:07:04 2005]"])}
    for kind, (kept, others) in cases.items():
        data, typed = log_columns.encode_texts(kind, kept + others)
        assert typed == len(kept) and log_columns.decode_texts(kind, data, len(kept + others)) == kept + others


def test_unpacked_logs(tmp_path):
    import tarfile
    import zipfile

    from tidemark.sources.files import unpack_log

    held = {"a.log": "small", "sub/b.log": "larger log", "c.txt": "x" * 99}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for name, text in held.items():
            z.writestr(name, text)
            (tmp_path / name).parent.mkdir(exist_ok=True)
            (tmp_path / name).write_text(text)
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name in held:
            t.add(tmp_path / name, name)
    for archive in ("z.zip", "t.tar.gz"):
        path = unpack_log(str(tmp_path / archive), str(tmp_path / "out" / archive))
        assert path.endswith("b.log") and open(path).read() == "larger log"


def test_tables():
    rows = [(k, "cpu", float(k), {"host": "é", "z": str(k % 3)} if k % 2 else {}) for k in range(50)]
    assert frames.table_decode(frames.table_encode(rows)) == rows and frames.table_decode(frames.table_encode([])) == []
    wide = [(0, f"name{k}", 0.0, {}) for k in range(70_000)]
    assert frames.table_decode(frames.table_encode(wide)) == wide


def test_templates_leave_out_blank_and_null_lines(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, " \t"), (3, " a 1 ")], "line_no long, line string")
    assert [(r.line_no, r.template) for r in templates.extract(df).collect()] == [(3, "a <NUM>")]
    assert templates.extract(df.limit(0)).count() == 0


def test_stream_rollup(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    points = [(t0 + datetime.timedelta(minutes=k), "s", float(k)) for k in range(12)]
    schema = "ts timestamp, series string, value double"
    spark.createDataFrame(points, schema).write.parquet(str(tmp_path / "in"))
    stream = stream_rollup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.avg_value, r.points) for r in spark.sql("SELECT * FROM rolled").collect()) == [(2.0, 5), (7.0, 5), (10.5, 2)]
