import base64
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

import pytest

from tessera.llm import secrets

TOKEN = "token = abcdefgh12345"


def found(text):
    return secrets.render(secrets.deep_scan(text)[1])


def brute(text):
    out = []
    for kind, pattern, flags, group, least in (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 0, 16), ("hex", r"[0-9a-f]+", 0, 0, 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    order = {"assign": 0, "access": 1, "hex": 2}
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], order[x[1]])))


def test_base_matches_the_patterns():
    rng = random.Random(9)
    bits = ["password", "TOKEN", "secret", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234", "deadbeef" * 4, "abc", "\n", "ſecret", "é", "/x+", "-"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert secrets.render(secrets.scan(text)) == brute(text), text


def test_failing_matches_consume():
    assert secrets.scan("token=secret: abcdefghij") == []


@pytest.mark.parametrize("wrap", [
    lambda s: urllib.parse.quote(s, safe=""),
    lambda s: urllib.parse.quote(urllib.parse.quote(s, safe=""), safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    lambda s: base64.b64encode(base64.b64encode(s.encode())).decode(),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(zlib.compress(s.encode()))).decode(),
    lambda s: urllib.parse.quote(base64.b64encode(zlib.compress(s.encode())).decode(), safe=""),
], ids=range(10))
def test_layers(wrap):
    inner = wrap(TOKEN)
    text = f"see {inner} end"
    base, spans = secrets.deep_scan(text)
    deep = [x for x in spans if x not in base and x[1] == 0]
    assert deep, text
    a, _, b = deep[0]
    assert 4 <= a < b <= 4 + len(inner)


def test_spans_are_mapped():
    text = "é %74oken%3Dabcdefgh%31 x"
    assert found(text) == "assign:2:23"
    enc = base64.b64encode(b"xxx " + TOKEN.encode() + b" yyyyyy").decode()
    a, _, b = secrets.deep_scan(enc)[1][0]
    assert base64.b64decode(enc[a // 4 * 4 : -(-b // 4) * 4]).find(b"token") >= 0 and b - a <= -(-len(TOKEN) * 4 // 3) + 3


def test_plain_words_are_clean():
    assert secrets.deep_scan("Donaudampfschifffahrtsgesellschaft 100%25 of AAAAAAAAAAAAAAAAAAAA") == ([], [])


def test_cycles_end():
    assert secrets.deep_scan("%2525252525" * 50)[0] == []


def test_query_shape(spark):
    rows = [(1, None), (2, ""), (3, TOKEN), (3, TOKEN), (None, "AKIA" + "B" * 12), (5, "x " * 100_000 + "0" * 32)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 spans")
    got = {(r["id"], r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in secrets.secret_scan(docs).collect()}
    assert got == {(1, 0, 0, 0, ""), (2, 0, 0, 0, ""), (3, 1, 0, 0, "assign:0:21"), (None, 0, 1, 0, "access:0:16"), (5, 0, 0, 1, "hex:200000:200032")}
    r = next(r for r in secrets.secret_scan(docs).collect() if r["id"] == 3)
    assert r["base_sha256"] == hashlib.sha256(b"assign:0:21").hexdigest()
    assert secrets.secret_scan(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, f"a {TOKEN} b {'0' * 32}"), (2, None), (3, "clean")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in secrets.redact_secrets(docs).collect()) == [(1, "a [SECRET] b [SECRET]"), (2, None), (3, "clean")]


@pytest.mark.parametrize("text", ['"token": "\\u0061bcdefgh123"', "password = %70assw0rd123", "password%3A hunter2long", "secret &#61; abcd1234efgh", "a 100%25 &#x74;oken = %61bcdefgh1 b"])
def test_escapes_and_literal_spaces_around_the_separator(text):
    kind, a, b = found(f"see {text} end").split(",")[-1].split(":")
    assert kind == "assign" and 4 <= int(a) < int(b) <= 4 + len(text)
    assert secrets.redact(f"see {text} end").count("[SECRET]") == 1


def test_a_key_before_an_escaped_run_takes_nothing_from_it():
    assert "assign:7:28" in found("token: api_key%3Ahunter2long").split(",")  # the whole has token: api_key, too short


def test_urlsafe_base64_is_one_run():
    rng = random.Random(4)
    for _ in range(300):
        body = f"{rng.random()} password={rng.getrandbits(64):016x} {rng.random()}".encode()
        enc = base64.urlsafe_b64encode(zlib.compress(body)).decode().rstrip("=")
        for text in (enc, f"see {enc} end", f"http://h/a/{enc}", f"http://h/some-long_name/{enc}?x=1"):
            assert "assign" in found(text), text


@pytest.mark.parametrize("before", ["", "a", "ab", "abc", "x/y/", "some/longer/path/z/"])
@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress, zlib.compress])
def test_base64_at_any_alignment(before, pack):
    enc = base64.b64encode(pack(b"so " + TOKEN.encode() + b" it is")).decode()
    assert "assign" in found(f"{before}{enc} end")


@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n    "])
@pytest.mark.parametrize("width", [10, 64, 76])
@pytest.mark.parametrize("pack", [lambda b: b, zlib.compress])
def test_wrapped_base64_is_joined(newline, width, pack):
    rng = random.Random(3)
    enc = base64.b64encode(pack(rng.randbytes(90).hex().encode()[:45] + b" " + TOKEN.encode() + b" " + rng.randbytes(90).hex().encode()[:31])).decode()
    text = "key: " + newline.join(enc[i : i + width] for i in range(0, len(enc), width)) + "\nand more\n"
    assign = [x for x in secrets.deep_scan(text)[1] if x[1] == 0]
    assert assign and all(5 <= a < b <= len(text) - 10 for a, _, b in assign)


@pytest.mark.parametrize("odd", ["\u00a0", "\u200b", "\ufeff", "\u3000", "\0", "\x1b"])
@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_layers_with_unprintable_characters_are_scanned(odd, pack):
    assert "assign" in found(base64.b64encode(pack(f"{odd} {TOKEN} {odd}".encode())).decode())
    assert "assign" in found(base64.b64encode(pack(f" {TOKEN} \xff".encode("latin-1"))).decode())


def test_long_runs_take_linear_time():
    assert secrets.deep_scan("A" * 300_000 + " " + "AbCd" * 80_000) == ([], [])


def _bare(data):
    c = zlib.compressobj(9, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


NOISE = random.Random(1).randbytes(300)


@pytest.mark.parametrize("raw", [
    TOKEN.encode("utf-16"), f"hello {TOKEN}".encode("utf-16-be"), f"x {TOKEN}".encode("utf-32-le"), NOISE + TOKEN.encode() + NOISE, gzip.compress(b"one") + gzip.compress(TOKEN.encode()), gzip.compress((TOKEN + " ").encode() + NOISE)[:-40], _bare(TOKEN.encode() * 3),
    gzip.compress(gzip.compress(zlib.compress(TOKEN.encode()))), zlib.compress(TOKEN.encode()) + b"tail", base64.b64encode(base64.b64encode(gzip.compress(TOKEN.encode()))),
])
def test_layers_of_bytes(raw):
    text = f"lead {base64.b64encode(raw).decode()} tail"
    got = [x for x in secrets.deep_scan(text)[1] if x[1] == 0]
    assert got and all(5 <= a < b <= len(text) - 5 for a, _, b in got)


@pytest.mark.parametrize("text", ["pass" + "%" + "25" * 50_000 + "77ord=hunter2hunter2", "\\" + "u005c" * 5_000 + "u0070assword=hunter2hunter2", "&#37;" * 20_000 + " token=abcdefgh1", "%%32" * 25_000 + "35 token=abcdefgh1", "%" * 100_000 + " token=abcdefgh1"])
def test_deep_escapes_take_linear_time(text):
    import time

    began = time.process_time()
    assert "assign" in found(text)
    assert time.process_time() - began < 5


def test_the_fixpoint_is_reached_at_any_depth():
    for depth in (1, 2, 7, 8, 9, 30):
        text = "x %" + "25" * depth + "74oken=abcdefgh1 y"
        assert f"assign:2:{len(text) - 2}" in found(text).split(","), depth


def test_compression_bombs_are_scanned_in_windows(monkeypatch):
    monkeypatch.setattr(secrets, "WINDOW", 1 << 20)
    data = bytes(5 << 20) + TOKEN.encode() + bytes(5 << 20)
    enc = base64.b64encode(gzip.compress(gzip.compress(data))).decode()
    assert "assign" in found(enc)
    monkeypatch.setattr(secrets, "MOST", 1 << 20)  # beyond the budget nothing more comes, and nothing breaks
    assert found(enc) == ""
