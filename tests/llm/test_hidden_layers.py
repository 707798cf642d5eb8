"""Secrets in layers that are not clean text, wrapped, of several members, or larger than a window."""

import base64
import bz2
import gzip
import lzma
import random
import textwrap
import zlib
from urllib.parse import quote

import pytest

from shopweave.llm import secret_scan as SS

PLAIN = 'token = "abcdef123456"'


def b64(data):
    return base64.b64encode(data).decode()


def assigns(text, **options):
    return [(s, e) for s, k, e in SS.scan(text, **options)[1] if k == 0]


@pytest.mark.parametrize("odd", ["\u00a0", "\ufeff", "\u200b", "\u00ad", "\0", "\f"])
def test_odd_characters_hide_nothing(odd):
    packed = b64((odd + PLAIN).encode())
    assert assigns(f"q {packed} z") == [(2, 2 + len(packed))]


def test_other_encodings_hide_nothing():
    assert assigns(b64(b"caf\xe9 " + PLAIN.encode()))
    assert assigns(b64(gzip.compress(b"\xff\xfe\x80" + PLAIN.encode())))


@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("width", [20, 64, 76])
@pytest.mark.parametrize("before", ["", "word\n", "Content\n", "key: "])
@pytest.mark.parametrize("gap", ["\n", "\r\n", "\n  ", "\\n"])
def test_wrapped_runs(pack, width, before, gap):
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghij ") for _ in range(300))
    lines = textwrap.wrap(b64(pack(f"{noise} {PLAIN} {noise}".encode())), width)
    text = before + gap.join(lines)
    assert len(text) in {e for _, e in assigns(text)}


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_all_members_are_read(pack):
    assert assigns(b64(pack(b"first") + pack(b"second") + pack(PLAIN.encode())))
    assert assigns(b64(pack(b"first") + PLAIN.encode()))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
@pytest.mark.parametrize("before", [0, 4090, 4096, 6000, 3 << 20])
def test_unfolded_texts_are_read_to_their_end(pack, before):
    assert assigns(b64(pack(("\u00e9" * (before // 2) + PLAIN).encode())), limit=4096)
    assert assigns(b64(pack(pack(("\u00e9" * (before // 2) + " " + b64(PLAIN.encode())).encode()))), limit=4096)


def test_one_bad_byte_or_half_spoils_no_run():
    run = "".join(f"%{b:02x}" for b in PLAIN.encode())
    assert assigns("%ff" + run) == [(3, len(run))]
    assert assigns("\\ud800" + "".join(f"\\u{ord(c):04x}" for c in PLAIN)) == [(6, 6 * len(PLAIN))]
    assert assigns(quote("\u00e9" + PLAIN))


def test_every_nesting_is_unwrapped():
    """Against brute force: a secret under random layers is found where the outermost layer stands, and one that none of them holds is not."""
    import bz2
    import lzma
    import random
    from urllib.parse import quote

    b64 = lambda x: base64.b64encode(x).decode()
    wraps = {
        "base64": lambda t: b64(t.encode()),
        "safe": lambda t: base64.urlsafe_b64encode(t.encode()).decode(),
        "mime": lambda t: base64.encodebytes(t.encode()).decode().strip(),
        "gzip": lambda t: b64(gzip.compress(t.encode())),
        "zlib": lambda t: b64(zlib.compress(t.encode())),
        "bz2": lambda t: b64(bz2.compress(t.encode())),
        "xz": lambda t: b64(lzma.compress(t.encode())),
        "url": lambda t: "".join(f"%{x:02x}" for x in t.encode()),
        "quoted": lambda t: quote(t, safe=""),
        "unicode": lambda t: "".join(f"\\u{ord(c):04x}" for c in t),
        "entities": lambda t: "".join(f"&#{ord(c)};" for c in t),
    }
    rng = random.Random(21)
    for _ in range(120):
        names = rng.choices(list(wraps), k=rng.randint(1, 4))
        body, other = 'password = "hunter2hunter2"', "nothing to find in these plain words"
        for name in names:
            body, other = wraps[name](body), wraps[name](other)
        text = f"before {body} after {other} end"
        spans = SS.scan(text)[1]
        found = [(s, e) for s, k, e in spans if k == 0]
        assert found and all(7 <= s and e <= 7 + len(body) for s, e in found), (names, text[:200], found)


@pytest.mark.parametrize("before", ["", " ", "https://a.com/", "https://a.com/d/", "v-", "id_", "a/b/c/", "x+", "ab", "abc", "files/2024-01-02/key_"])
@pytest.mark.parametrize("pack", [bytes, gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_what_stands_before_hides_nothing(before, pack):
    packed = b64(pack(b"password: hunter2hunter2"))
    for after in ("", "/tail", " z"):
        text = before + packed.rstrip("=") + after if after == "/tail" else before + packed + after
        found = assigns(text)
        assert found and all(e > len(before) for _, e in found), (text, found)


def test_place_behind_a_name():
    packed = b64(b"password: hunter2hunter2")
    assert (3, 3 + len(packed)) in assigns(f"id_{packed} z")


@pytest.mark.parametrize("head", ["eA", "eAE", "eJw", "H4sI", "QlpoO"])
def test_lines_that_look_packed_take_linear_time(head):
    import time

    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    lines = [head + "".join(rng.choices(letters, k=76 - len(head))) for _ in range(50_000)]
    began = time.process_time()
    SS.scan("\n".join(lines))
    assert time.process_time() - began < 60
    secret = textwrap.wrap(b64(zlib.compress(PLAIN.encode() * 9)), 76)
    assert assigns("\n".join(lines[:3000] + secret))


def test_worklist_against_all_decodings():
    """A plain worklist that tries each decoder from each character finds no secret that the scan misses."""
    from urllib.parse import unquote

    def plain(text):
        work, seen, hits = [text], {text}, 0
        while work:
            own = work.pop()
            hits += any(k == 0 for _, k, _ in SS.base_spans(own))
            new = [unquote(own, errors="replace")]
            for m in re.finditer(r"[A-Za-z0-9+/_-]{16,}", own):
                for i in range(len(m[0]) - 15):
                    body = m[0][i:].replace("-", "+").replace("_", "/")
                    data = base64.b64decode(body[: len(body) // 4 * 4])
                    new.append(data.decode("latin-1"))
                    for unpack in (lambda d: zlib.decompressobj(47).decompress(d), lambda d: bz2.BZ2Decompressor().decompress(d)):
                        try:
                            new.append(unpack(data).decode("latin-1"))
                        except (OSError, zlib.error):
                            pass
            for x in new:
                if x not in seen and any(c in x for c in "=:%") or re.search("[A-Za-z0-9+/_-]{16,}", x) and x not in seen and x.isascii():
                    seen.add(x)
                    work.append(x)
        return hits > 0

    import re

    rng = random.Random(9)
    for _ in range(40):
        text = rng.choice([PLAIN, "nothing to see here at all"])
        for _ in range(rng.randint(1, 3)):
            wrap = rng.choice([lambda t: b64(t.encode()), lambda t: b64(zlib.compress(t.encode())), lambda t: b64(bz2.compress(t.encode())), lambda t: quote(t, safe="")])
            text = rng.choice(["", "a/", "id_", "v1-", "x ", "key/"]) + wrap(text).rstrip("=")
        assert bool(assigns(text)) == plain(text), text
