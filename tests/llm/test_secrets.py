"""The assignment lexer: forms with known literals, spans against a plain reader, and hostile texts."""

import random
import re
import time

import pytest

from molspark.llm import secrets

V = "Xk29-qLm47!zPw83"


def found(text):
    return [text[a:b] for a, b, _ in secrets.added_spans(text)]


@pytest.mark.parametrize(("text", "want"), [
    (f'client_secret = "{V}"', [V]), (f'{"x" * 200}_client_secret_{"a" * 200} = "{V}"', [V]), (f"CLIENT_SECRET={V}", [V]), (f'{{"client_secret": "{V}"}}', [V]),
    (f"client_secret => '{V}'", [V]), (f"client_secret := `{V}`", [V]), (f'client_secret = """{V}"""', [V]), (f"client_secret = b'{V}'", [V]), (f'client_secret: str = "{V}"', [V]),
    (f'const clientSecret: string = "{V}";', [V]), (f'headers["client_secret"] = "{V}"', [V]), (f'define("CLIENT_SECRET", "{V}")', [V]),
    (f"<client_secret> {V}\n</client_secret>", [V]), (f'<add key="ClientSecret" value="{V}"/>', [V]), (f'<entry key="db.secret_key">{V}</entry>', [V]), (f"- name: CLIENT_SECRET\n  value: {V}", [V]),
    ("key:\n  client_secret: |\n    Xk29-qLm47\n    !zPw83abc\n  other: 1", ["Xk29-qLm47", "!zPw83abc"]),
    (f"it's fine: don't set client_secret: {V}.", [V]), (f'client_secret = "a\\"{V}"', [f'a\\"{V}']),
    # constants stand for their literals, where these are defined
    (f'db_pw_const = "{V}"\nclient_secret = db_pw_const', [V]), ('a = "Xk29-qLm"\nclient_secret = a + "47!zPw83"', ["Xk29-qLm", "47!zPw83"]), (f'k = "{V}"\nj = k\nclient_secret = j', [V]),
    (f'k = "{V}"\nk = f()\nclient_secret = k', []), ('x = "Xk29-qLm"\nx += "47!zPw83"\nclient_secret = x', ["Xk29-qLm", "47!zPw83"]),
    # no literals, or none that looks secret
    ("client_secret = get_token(abcdef1)", []), ("client_secret = config.password", []), (f'client_secret == "{V}"', []), (f'colour = "{V}"', []), ('client_secret = "your-key-1234567"', []),
    ("client_secret = 'unterminated-abc123\nx", []), ("", []), ("=:<(", []),
])
def test_literals(text, want):
    assert found(text) == want
    assert not want or all(w not in secrets.redact(text, secrets.all_spans(text)) for w in want)


HOSTILE = {
    "blanks": " " * 1_000_000 + "=", "operators": "=" * 1_000_000, "quotes": '"' * 1_000_000, "escapes": '\\"' * 500_000 + "=", "backslashes": '="' + "\\" * 1_000_000, "ticks": "=`" * 300_000, "tags": "<a>" * 300_000,
    "doubling": 'a = "x"\n' + "a = a + a\n" * 60, "chain": 's="x"\n' + "".join(f's{i} = s{i - 1 if i else ""} + "b"\n' for i in range(40_000)), "joins": 'x="a"' + '+"a"' * 200_000, "blocks": "a: |\n" * 150_000,
    "one line": "='" * 1_500_000, "deep line": " " * 500_000 + "a:1 " * 100_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_is_in_proportion(name):
    began = time.perf_counter()
    secrets.all_spans(HOSTILE[name])
    assert time.perf_counter() - began < 15


def test_spans_of_made_up_files_with_known_literals():
    """Files of random statements, each with the literals it should give, and none for those of harmless names."""
    rng = random.Random(3)
    for _ in range(300):
        text, want = "", set()
        for i in range(rng.randrange(1, 12)):
            value = "".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(rng.randrange(18, 40))) + "7Q"
            secret = rng.random() < 0.6
            name = f"{rng.choice(['api_secret', 'userPassword', 'AUTH_TOKEN', 'private.key'])}" if secret else rng.choice(["colour", "path", "title"])
            form = rng.choice(['{n} = "{v}"', "{n}: {v}", '"{n}": "{v}",', "{n}='{v}'", "<{n}>{v}</{n}>", "alias{i} = '{v}'\n{n} = alias{i}"]).replace("{n}", name).replace("{i}", str(i))
            text += form.replace("{v}", value) + "\n"
            if secret:
                want.add(value)
        assert set(found(text)) == want, text


def test_literals_of_documents_against_a_plain_reader(spark):
    """Every document: names and values around each sign, read character by character."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(docs).collect()}
    for d in docs.collect():
        text, want = d.text, set()
        for m in re.finditer("[=:]", text):
            i = m.start()
            while i and text[i - 1] in " \"'":
                i -= 1
            j = i
            while j and (text[j - 1].isalnum() or text[j - 1] in "_.-"):
                j -= 1
            k = m.end()
            while k < len(text) and text[k] == " ":
                k += 1
            quote = text[k] if text[k : k + 1] in ("'", '"') else ""
            e = k = k + len(quote)
            while e < len(text) and (text[e] != quote if quote else not text[e].isspace() and text[e] not in "\"'`,;&(){}[]<>|"):
                e += 1
            value = text[k:e].rstrip(".:") if not quote else text[k:e]
            if secrets.name_score(text[j:i]) >= 1 and secrets.literal_score(value) >= 2 and secrets.name_score(text[j:i]) + secrets.literal_score(value) >= 4 and (quote or re.search("[0-9]", value)):
                want.add(f"literal:{k}:{k + len(value)}")
        assert {s for s in got[d.doc_id].split(",") if s.startswith("literal")} == want, d.doc_id


@pytest.mark.parametrize("n", [2, 256, 257, 300])
def test_joined_literals_of_any_length(n):
    """Every piece of a joined secret is found, on one line, over lines, added up and by way of constants."""
    pieces = [f"{chr(97 + i % 26)}{chr(65 + i // 26 % 26)}{i % 10}x" for i in range(max(n, 5))]
    want = len(pieces)
    for text in (
        "client_secret = " + " + ".join(f'"{p}"' for p in pieces),
        "client_secret = " + " + \\\n  ".join(f'"{p}"' for p in pieces),
        'client_secret = ""\n' + "".join(f'client_secret += "{p}"\n' for p in pieces),
        "".join(f'k{i} = "{p}"\n' for i, p in enumerate(pieces)) + "client_secret = " + " + ".join(f"k{i}" for i in range(len(pieces))),
    ):
        spans = secrets.added_spans(text)
        assert len(spans) == want and [text[s:e] for s, e, _ in spans] == pieces, text[:60]
        assert not any(p in secrets.redact(text, spans) for p in pieces)


LONG = {"called": "a=" * 100_000 + "a(", "colons": "a:" * 100_000 + "[", "dots": "a=" * 1000 + "." * 100_000 + "(",
           "sums": "k0 = 'Ab9'\n" + "".join(f"k{i + 1} = k{i} + 'Q7x'\n" for i in range(10_000)) + "api_token = k10000\n",
           "doubled": "k0 = 'Ab9xYz77'\n" + "".join(f"k{i + 1} = k{i} + k{i}\n" for i in range(10_000)) + "api_token = k10000\n",
           "added": "secret_key = 'Zq9'\n" + "secret_key += 'Zq9xT'\n" * 10_000}


@pytest.mark.parametrize("name", sorted(LONG))
def test_hostile_texts_take_linear_time(name):
    """Five times the length of a text that a quadratic reader takes a minute for; the bound is generous for slow machines."""
    began = time.process_time()
    secrets.added_spans(LONG[name])
    assert time.process_time() - began < 5
