import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lineform.llm import personal_data as P


def brute(text):
    out = []
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and P.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def base(text):
    return [s for s in P.find(text) if s[0] in P.BASE]


@settings(max_examples=600, deadline=None, derandomize=True)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "1", "255", "256", "00", "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "+1 ", "(", ")", "-", " ", "%", "é", "x@y.z", "1.2.3.4", "\n", "https://", "iban "]), max_size=24).map("".join))
def test_like_the_patterns(text):
    assert base(text) == brute(text)


def test_added_and_redacted():
    text = "IBAN DE89 3704 0044 0532 0130 00, account no: 12345678; https://u:p@h.org/x mail a@b.co"
    kinds = [k for k, _, _ in P.find(text)]
    assert {"email", "link", "iban", "account"} <= set(kinds)
    new = P.redact(text)
    assert "[IBAN]" in new and "[ACCOUNT]" in new and "a@b.co" not in new and "u:p" not in new
    assert P.redact(None) is None and P.redact("") == "" and P.redact("clean text 12") == "clean text 12"


def test_long_runs_are_linear():
    for unit in ("1", "1.", "+1", "a@", "a.", "1 ", "account 1"):
        P.find(unit * 100_000)


def test_frame(spark):
    random.seed(3)
    rows = [(1, None, "a"), (1, "a@b.cd", "b"), (2, "", None), (None, "+49 170 1234567", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = P.spans(df).collect()
    assert sorted(len(r.spans) for r in out) == [0, 0, 1, 1]
    assert [r.text for r in P.redacted(df).orderBy("spans").collect()][1:] == [None, "[EMAIL]", "[PHONE]"]
    assert P.spans(df.limit(0)).count() == 0
