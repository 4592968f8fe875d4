"""Private keys are redacted whole."""
import pytest

from sparkaudit.llm.secrets_ledger import RULES, cut, find_spans

BODY = "MIIEowIBAAKCAQEAx\nq8Zr0fJ+abc/def==\n"
ENCRYPTED = ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C3D\n\n" + BODY
             + "-----END RSA PRIVATE KEY-----")
PGP = ("-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: GnuPG v2 - beta\n\n" + BODY
       + "=AbCd\n-----END PGP PRIVATE KEY BLOCK-----")
PLAIN = "-----BEGIN PRIVATE KEY-----\n" + BODY + "-----END PRIVATE KEY-----"


def redacted(text):
    return cut(text, [(a, b) for _, a, b in find_spans(text, RULES)], "[secret]")


@pytest.mark.parametrize("key", [ENCRYPTED, PGP, PLAIN])
def test_whole_keys(key):
    assert redacted(f"before - it\n{key}\nafter - it") == "before - it\n[secret]\nafter - it"


def test_two_keys_and_text_between():
    assert redacted(f"{ENCRYPTED}\na - b\n{PLAIN} c") == "[secret]\na - b\n[secret] c"


@pytest.mark.parametrize("key", [ENCRYPTED, PLAIN])
def test_without_end(key):
    open_key = key[:key.index("-----END")]
    assert redacted(f"{open_key}- a\n{PLAIN}\nz") == "[secret]- a\n[secret]\nz"
