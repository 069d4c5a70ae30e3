"""Made-up personal data and look-alikes, planted into training texts where no labels exist."""

from __future__ import annotations

import random
from collections.abc import Callable

Planted = tuple[int, int, int, bool]  # start, kind (as in privacy.KINDS), end, personal

_NAMES = ("ann", "jo.lee", "m_schmidt", "info", "r.costa", "support", "li-wei", "k.novak", "sales.eu", "p.dubois")
_HOSTS = ("example", "mail", "post-box", "firma", "uni", "city", "blue-sky", "shop24")
_ENDS = ("org", "com", "net", "de", "fr", "es", "info")
#: Words that stand before personal data and before look-alikes; a third of all plants gets none.
CUES = {
    0: ("mail", "e-mail:", "write to", "contact", "correo", "courriel"),
    1: ("ip", "from", "host", "client address", "server", "login from"),
    2: ("card", "visa", "paid with", "credit card no.", "karte", "tarjeta"),
    3: ("call", "tel", "phone:", "mobile", "telefon", "fax", "reach me at"),
}
DECOY_CUES = ("order", "invoice no.", "version", "release", "isbn", "ref:", "ticket", "serial", "section", "date", "batch", "tracking", "id")


def _digits(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=n - 1))


def _check_digit(body: str) -> int:
    total = 0
    for i, d in enumerate(reversed(body)):
        n = int(d)
        total += (n * 2 - 9 if n > 4 else n * 2) if i % 2 == 0 else n
    return -total % 10


def _card_digits(rng: random.Random, n: int, valid: bool) -> str:
    body = rng.choice("3456") + "".join(rng.choices("0123456789", k=n - 2))
    last = _check_digit(body)
    return body + str(last if valid else (last + rng.randint(1, 9)) % 10)


def _grouped(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at:at + n])
        at += n
    return sep.join(out)


def _card(rng: random.Random, valid: bool) -> str:
    shape = rng.randrange(4)
    if shape == 0:
        return _grouped(_card_digits(rng, 16, valid), (4, 4, 4, 4), rng.choice(" -"))
    if shape == 1:
        return _grouped(_card_digits(rng, 15, valid), (4, 6, 5), rng.choice(" -"))
    return _card_digits(rng, rng.choice((13, 14, 15, 16, 19)) if shape == 2 else 16, valid)


def _email(rng: random.Random) -> str:
    name, host = rng.choice(_NAMES) + rng.choice(("", str(rng.randint(1, 99)))), rng.choice(_HOSTS)
    at, dot = rng.choice((("@", "."), (" (at) ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" [at] ", ".")))
    return name + at + host + dot + rng.choice(_ENDS)


def _ip(rng: random.Random) -> str:
    return ".".join([str(rng.randint(1, 255)), *[str(rng.randint(0, 255)) for _ in range(3)]])


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    sep = rng.choice(" -.")
    return rng.choice((
        f"({a}) {b}-{c}", f"({a}) {b} {c}", sep.join((a, b, c)), f"0{_digits(rng, 3)}{sep}{_digits(rng, rng.randint(6, 8))}",
        f"00{_digits(rng, 2)}{sep}{a}{sep}{_digits(rng, 7)}", f"+{_digits(rng, 2)}{sep}{a}{sep}{b}{sep}{c}", f"+{_digits(rng, rng.randint(10, 13))}",
        f"{_digits(rng, 1)}{sep}{a}{sep}{b}{sep}{c}"))


PERSONAL: dict[int, Callable[[random.Random], str]] = {0: _email, 1: _ip, 2: lambda rng: _card(rng, True), 3: _phone}


def _decoy(rng: random.Random) -> str:
    """Numbers that look like personal data: orders, dates with times, versions, book and serial numbers, sums."""
    return rng.choice((
        lambda: _digits(rng, rng.randint(10, 19)), lambda: _card(rng, False),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d} {rng.randint(1990, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}",
        lambda: f"{rng.randint(1, 28):02d}.{rng.randint(1, 12):02d}.{rng.randint(1990, 2030)} {_digits(rng, rng.randint(3, 6))}",
        lambda: f"978-{_digits(rng, 1)}-{_digits(rng, 3)}-{_digits(rng, 5)}-{_digits(rng, 1)}",
        lambda: f"{rng.randint(0, 30)}.{rng.randint(0, 99)}.{rng.randint(256, 9999)}.{rng.randint(0, 9999)}",
        lambda: f"{_digits(rng, 3)}-{_digits(rng, 3)}-{_digits(rng, 4)}", lambda: f"{_digits(rng, 2)} {_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 4)}",
        lambda: "met (at) home. We", lambda: f"look @ {rng.choice(_HOSTS)} now",
    ))()


def plant(text: str, rng: random.Random, n: int = 4) -> tuple[str, list[Planted]]:
    """``text`` with ``n`` strings put in at blanks, about half of them personal, and where each one stands.

    Look-alikes that share their format with personal data (plain digit groups) come with a word of
    ``DECOY_CUES`` before them, and such personal data with a word of ``CUES``, so that context decides there.
    A plant is followed by a blank, a full stop or a comma.
    """
    places = [i for i, c in enumerate(text) if c == " "] or [len(text)]
    out, marks, cursor, size = [], [], 0, 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    for place in sorted(rng.sample(places, min(n, len(places)))):
        put(text[cursor:place] + " ")
        cursor = place
        kind, personal = rng.randrange(4), rng.random() < 0.5
        own = PERSONAL[kind](rng) if personal else _decoy(rng)
        bare = kind == 3 and own[0] not in "+(" if personal else own[0].isdigit()
        if bare or rng.random() < 2 / 3:
            put(rng.choice(CUES[kind] if personal else DECOY_CUES) + " ")
        marks.append((size, kind, size + len(own), personal))
        put(own + rng.choice(("", "", ".", ",")))
    put(text[cursor:])
    return "".join(out), marks
