"""Secrets without digits, before their label, in many lines, and touched by a fixed pattern."""

import base64
import random

from gsx.llm.secrets import Scanner

RNG = random.Random(1)


def novel(text):
    return [text[a:b] for a, k, b in Scanner().spans(text) if k == 3]


def letters(n):
    return "".join(RNG.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))


def test_letters_only_and_label_after():
    key = letters(24)
    assert novel(f"the credential is {key}") == [key]
    assert novel(f"{key} is the passphrase of the host") == [key]
    assert novel(f"{key} is a name") == []


def test_every_line_of_a_private_key():
    for joint in ("\n", "\r\n", "\\n", '",\n    "'):
        lines = [base64.b64encode(RNG.randbytes(48)).decode() for _ in range(19)]
        text = f"-----BEGIN RSA PRIVATE KEY-----{joint}" + joint.join(lines) + f"{joint}-----END RSA PRIVATE KEY-----"
        assert len(novel(text)) == 19
    parts = [letters(20), letters(80), letters(43)]
    assert novel("bearer " + ".".join(parts)) == parts


def test_rest_of_a_touched_candidate():
    rest = letters(24) + "G"
    text = f"credential {rest}0123456789abcdef"
    assert novel(text) == [rest]
    assert novel(f"credential 0123456789abcdef{rest}") == [rest]
    assert novel("credential 0123456789abcdef0123 plain") == []
