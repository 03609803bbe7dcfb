"""The secret lexer on generated texts of which the pairs are known, and on texts that are hard to read."""

from __future__ import annotations

import random
import time

import pytest

from trajspark.llm import secrets

SECRET = "Zx9!kQ2m#Lw8"


def spans(text: str) -> list[str]:
    return [text[s:e] for _, s, e in secrets.pair_spans(text)]


FORMS = {
    "assignment": 'NAME = "SECRET"', "export": "export NAME='SECRET'", "json": '{"NAME": "SECRET", "x": 1}', "subscript": 'cfg["NAME"] = "SECRET"',
    "nested": "cfg['db'][ 'NAME' ] = 'SECRET'", "attribute": 'self.NAME = "SECRET"', "typed": 'NAME: Optional[str] = "SECRET"', "arrow": "'NAME' => 'SECRET',",
    "walrus": 'NAME := "SECRET"', "constant": "const NAME = `SECRET`;", "triple": 'NAME = """SECRET"""', "raw": "NAME = r'SECRET'",
    "comment between": 'NAME = /* of prod */ "SECRET"', "in a comment": '# old: NAME = "SECRET"', "in a block": '/* NAME="SECRET" */', "after a comment": 'x = 1 // note\nNAME = "SECRET"',
    "continued": 'NAME = \\\n    "SECRET"', "bracketed": 'NAME = (\n    "SECRET"\n)', "yaml": "NAME: 'SECRET'", "yaml below": "a:\n  NAME:\n    'SECRET'\n  b: 1",
    "xml": "<NAME>SECRET</NAME>", "xml attribute": '<db NAME="SECRET"/>', "key and value": '<add key="NAME" value="SECRET" />', "property": '<property name="NAME">SECRET</property>',
    "plist": "<key>NAME</key>\n  <string>SECRET</string>", "entries": '- name: NAME\n  value: "SECRET"', "json entries": '{"name": "NAME", "value": "SECRET"}',
    "propagated": 'first = "SECRET"\nsecond = first\nNAME = second', "unclosed before": "it's = so\nNAME = \"SECRET\"",
}


@pytest.mark.parametrize("form", FORMS)
def test_forms(form):
    """Every form in prose and other code: found with a sensitive name, and not with another one, nor a placeholder."""
    r = random.Random(form)
    for name in ("db_password", "ApiSecret", "access-key", "clientSecretKey"):
        if "-" in name and form in ("attribute", "typed", "constant", "walrus", "propagated", "assignment", "export"):
            name = name.replace("-", "_")
        text = FORMS[form].replace("NAME", name).replace("SECRET", SECRET)
        around = "Some prose with a password in it.\n" + "".join(f"v{k} = {r.randint(0, 9)}\n" for k in range(3))
        assert spans(around + text + "\nlast = 1\n") == [SECRET], text
        assert spans(around + FORMS[form].replace("NAME", "colour").replace("SECRET", SECRET)) == []
        assert spans(FORMS[form].replace("NAME", name).replace("SECRET", "changeme")) == []


def test_joined_literals():
    assert spans('db_password = "Zx9!" + "kQ2m#Lw8"') == ['Zx9!" + "kQ2m#Lw8']
    assert spans('db_password = ("Zx9!"\n   "kQ2m#Lw8")') == ['Zx9!"\n   "kQ2m#Lw8']
    assert spans('a = "Zx9!"\ndb_password = a + "kQ2m#Lw8"') == ["kQ2m#Lw8"]  # scored as a whole, stands where its own piece is
    assert spans("$token = 'Zx9!' . 'kQ2m#Lw8';") == ["Zx9!' . 'kQ2m#Lw8"]
    assert spans("private_key: |\n  MIIEpAIBAAKCAQ\n  qqqqZZ99\nother: 1") == ["MIIEpAIBAAKCAQ\n  qqqqZZ99"]


def test_what_is_no_literal():
    for text in (
        'secret = os.getenv("SECRET_NAME_X1")', f'if (password == "{SECRET}") {{', "password = other_name_9x", "colour: http://x.y/z",
        f"password != '{SECRET}'", "secret = ", "password:", '"password" "Zx9!kQ2m#Lw8"', "<password></password>", 'secret = """', "a.password = f(x)",
    ):
        assert spans(text) == [] or spans(text) == ["other_name_9x"], text


def test_lexer_takes_linear_time():
    for text in ('"' * 200_000 + " secret = ", "secret" + "/*" * 100_000, 'secret <a ' + 'b="c" ' * 30_000, "secret: \'\'\'" + "a\\" * 100_000, "secret = " + "(" * 50_000):
        began = time.perf_counter()
        secrets.pair_spans(text)
        assert time.perf_counter() - began < 10
