"""Ten thousand secrets against replacing them one by one, the longest first."""

import random

import pytest

from folioscope.functions import vocab as V
from folioscope.operators.redaction import redact_secret_table


@pytest.mark.parametrize("block_chars", [1 << 20, 9_000])
def test_many_secrets_equal_one_by_one(spark, block_chars):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé\u4f60") for _ in range(n))
    secrets = list({word(rng.randint(2, 9)) for _ in range(10_000)}) + [None, "", "   x   "]
    texts = [" ".join(word(rng.randint(1, 30)) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    texts += [secrets[0] * 3, "a" * 4000, None, ""]

    def one_by_one(text):
        if not text:
            return "UnknownError"
        known = {s for s in secrets if s and len(s.strip()) > V.MIN_SECRET_CHARS}
        for length in sorted(set(map(len, known)), reverse=True):
            i = 0
            while i + length <= len(text):
                if text[i:i + length] in known:
                    text = text[:i] + "\x00" * length + text[i + length:]
                i += 1
        return text

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, message string")
    table = spark.createDataFrame([(s,) for s in secrets], "secret string")
    found = {r.id: r.message for r in redact_secret_table(rows, table, marker="\x01", block_chars=block_chars).collect()}
    for i, t in enumerate(texts):
        left = one_by_one(t)
        # what stays between the secrets is alike, and every run of removed characters holds a marker
        assert found[i].replace("\x01", "") == left.replace("\x00", "")
        assert ("\x01" in found[i]) == ("\x00" in left)


def test_overlaps_markers_and_no_secrets(spark):
    rows = spark.createDataFrame([(1, "abcdefghijk abcdef abcdefabcdef"), (2, "REDACTED_API")], "id long, message string")
    table = spark.createDataFrame([("abcdef",), ("defghijk",), ("REDACTED",), ("cdefgh",)], "secret string")
    found = {r.id: r.message for r in redact_secret_table(rows, table).collect()}
    m = V.REDACTED
    assert found == {1: f"abc{m} {m} {m}{m}", 2: f"{m}_API"}
    assert {r.message for r in redact_secret_table(rows, table.limit(0)).collect()} == {"abcdefghijk abcdef abcdefabcdef", "REDACTED_API"}
    assert redact_secret_table(rows.limit(0), table).count() == 0


def test_a_task_holds_one_block_of_secrets(spark, rows):
    """With many blocks the last plan runs one Python step, and rows with equal texts stay as many as they are."""
    table = spark.createDataFrame([(f"secret-{i:03d}",) for i in range(200)], "secret string")
    texts = spark.createDataFrame([(i % 3, f"of secret-{i % 3:03d} and secret-199!") for i in range(9)] + [(None, None)], "id long, message string")
    out = redact_secret_table(texts, table, block_chars=100)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert rows(out.filter("id is not null")) == sorted([(i, f"of {V.REDACTED} and {V.REDACTED}!") for i in range(3)] * 3)
    assert out.filter("id is null").first().message == "UnknownError"
