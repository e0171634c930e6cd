"""The gate before the rules of credentials."""

from __future__ import annotations

import pytest

from siftbed.llm import credentials

ALL = {*range(len(credentials._RULES)), *(100 + k for k in range(len(credentials._VENDOR))), 200}

SECRET = "S3cretPw9!x"
TEXTS = [
    f"password     = {SECRET}", f"password\t= {SECRET}", f"api_key\t:\t{SECRET}", f"mysql -u root -p{SECRET}", f"sshpass -p\t{SECRET} ssh host", f"log in with pass {SECRET}", f"with the password\t{SECRET}",
    f"the password is:  {SECRET}", f"the token\nwas {SECRET}", f"ENV\tDB_PASSWORD {SECRET}", f"curl -u\tme:{SECRET} host", f"authorization basic\t{SECRET}", f"<add key='DbPassword'  value = '{SECRET}'/>", f"<password>{SECRET}</password>",
]


@pytest.mark.parametrize("text", TEXTS)
def test_the_gate_lets_through_what_a_rule_finds(text, monkeypatch):
    gated = credentials.find_credentials(text)
    assert [text[a:b] for a, b, _ in gated] == [SECRET]
    monkeypatch.setattr(credentials, "_worth_running", lambda _: ALL)
    assert credentials.find_credentials(text) == gated


def test_the_gate_opens_for_every_rule():
    for text in ("PAßWORD", "PAſſWORD = 'Ab12cd34ef'", "SİG=ab12cd34ef56", "TOKEN => 'ab12cd34'", "no names here", "-port=8080a-b -profile=dev-2x!"):
        rules, vendors, pem = credentials._compiled()
        fitting = {k for k, r in enumerate(rules) if r.search(text)} | {100 + k for k, r in enumerate(vendors) if r.search(text)} | ({200} if pem.search(text) else set())
        assert fitting <= credentials._worth_running(text), text
    assert credentials.find_credentials("run -profile=dev-2x! now") == []


def test_the_measure_decides(monkeypatch):
    """Without natural strings everything assigned is found; without unnatural ones only passwords of URIs are."""
    texts = ['token = "kTr!pqWz"', "password = 'snippet'", 'secret: "conversation"', "Das Kennwort lautet: Zk39QmPw2rT7yU1i", "postgres://svc:harbor@db/x", "api_key: 9fK2mQ7xW1pL4sV8"]
    found = [len(credentials.find_credentials(t)) for t in texts]
    assert found == [1, 0, 0, 1, 1, 1]
    monkeypatch.setattr(credentials, "_measure", lambda s, d: 1.0)
    assert sum(len(credentials.find_credentials(t)) for t in texts) > sum(found)
    monkeypatch.setattr(credentials, "_measure", lambda s, d: 9.0)
    assert [len(credentials.find_credentials(t)) for t in texts] == [0, 0, 0, 0, 1, 0]


def test_redaction_keeps_offsets_and_everything_else():
    text = 'a = 1\npassword = "Zk39QmPw2rT7yU1i"\r\n# tail €😀'
    spans = credentials.find_credentials(text)
    masked = credentials.redact(text, spans)
    assert [text[a:b] for a, b, _ in spans] == ["Zk39QmPw2rT7yU1i"] and len(masked) == len(text)
    assert masked.replace("*" * 16, "Zk39QmPw2rT7yU1i") == text


def test_tables(spark):
    secret = "Zk39QmPw2rT7yU1i"
    rows = [(1, f'password = "{secret}"', "x"), (1, f'password = "{secret}"', "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 40_000 + f'token="{secret}"', "x"), (5, 'variable "db_password" {\n' + "  # note\n" * 60 + f'  default = "{secret}"\n}}', "x")]
    texts = spark.createDataFrame(rows, "message_id bigint, text string, secrets string")
    got = sorted(((r.message_id, r.secrets) for r in credentials.scan_texts(texts).collect()), key=str)
    assert got == sorted([(1, [secret]), (1, [secret]), (2, []), (3, []), (4, [secret]), (5, [secret])], key=str)
    assert credentials.scan_texts(texts.limit(0)).count() == 0
    findings = spark.createDataFrame([(1, f'pw: "{secret}"', f'pw: "{secret}"'), (2, f'pw = "{secret}"', "pw =****..."), (3, "postgres://a:Zk3q@h/x", "Zk3q"), (4, None, None), (5, f'password = "{secret}"', "")], "finding_id bigint, matched_text string, redacted_text string")
    assert sorted((r.finding_id, r.secrets) for r in credentials.shown_in_redaction(findings).collect()) == [(1, [secret]), (3, ["Zk3q"])]
