"""Personal data against plain regular expressions over all places."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from oddgraph.llm import personal

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    d = [int(c) for c in digits[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def base(text):
    out = [(m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(PATTERNS[p], text or "") if valid(p, m.group())]
    return [(list(PATTERNS)[k], a, b) for a, k, b in sorted(out)]


def texts():
    rng = random.Random(11)
    bits = ["@", "a", "b.c", ".", "-", "+1", "+", " ", "1", "25", "255", "256", "0", "00", "12.3", "4111 1111 1111 1111", "(", ")", "x@y.z", "ü", "😀", "\n", "%", "_", "378282246310005", "9", "7-7"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(1500)]
    out += ["".join(rng.choice("0123456789 -+.()@a") for _ in range(rng.randrange(0, 80))) for _ in range(1500)]
    out += ["1.2.3.4.5.6.7.8.9", "1.2.3.400.5.6.7.8", "a@b.c@d.e", "a@b@c.d.", "a@b..c", "+4(9", "+49 (0)151 2345678.", "1" * 6000, "0001.002.03.4", "1.2.3", "", None, "x" * 9000 + "@a.b", ("q@r.st " * 900)]
    return out + out[:3]


def test_base_kinds_against_regular_expressions(spark, documents):
    ts = texts()
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in personal.found(documents(ts).repartition(3)).collect()}
    assert len(got) == len(ts)
    for i, t in enumerate(ts):
        assert [s for s in got[i] if s[0] in personal.BASE] == base(t), t


def test_added_kinds():
    kinds = lambda t: [(k, t[a:b]) for a, b, k in personal.spans_of(t) if k in personal.ADDED]
    assert kinds("see https://ann:pw@host.example/x and https://host.example/@ann") == [("url", "https://ann:pw@host.example")]
    assert kinds("xhttp://a@b, mailto://a@b, (FTP://ann@b)") == [("url", "FTP://ann@b")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00, IBAN DE88370400440532013000") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("iban no. GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert kinds("SSN 123-45-6789; ssn: 000-12-3456; Social Security number: 123 45 6789; 123-45-6789") == [("ssn", "123-45-6789"), ("ssn", "123 45 6789")]
    assert kinds("Account no. 1234 5678 90, an accountant 12345678, account 12345, accounts 1234567") == [("account", "1234 5678 90")]
    assert kinds("a quiet text about accounts, the iban and 12 houses") == []


def test_query_columns_and_redaction(spark, tmp_path):
    ts = ["mail a@b.cd or +1 (017) 555-7713 😀 a@b.cd", None, "", "clean", "card 4111 1111 1111 1111."]
    docs = spark.createDataFrame(list(enumerate(ts)) + [(None, "ip 1.2.3.4")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in personal.op13_personal_data(spark, str(tmp_path)).collect():
        want = base("ip 1.2.3.4" if r["doc_id"] is None else ts[r["doc_id"]])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r["spans"], r["base_sha256"]) == (line, hashlib.sha256(line.encode()).hexdigest())
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
    got = {r["doc_id"]: r["text"] for r in personal.redacted(docs).collect()}
    assert got == {0: "mail [EMAIL] or [PHONE] 😀 [EMAIL]", 1: None, 2: "", 3: "clean", 4: "card [CARD].", None: "ip [IP]"}
    assert personal.found(docs.where("false")).count() == 0 and personal.found(docs.withColumn("spans", F.lit(1))).count() == 6
