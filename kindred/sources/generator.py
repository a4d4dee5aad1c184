"""Synthetic entity-resolution data: businesses, their noisy copies in two pool sources, and the truth. Seeded and small."""

from __future__ import annotations

import random
import unicodedata
from pathlib import Path

FIRST = "blue green river stone silver golden royal city north summit pioneer lotus oak maple harbor delta".split()
SECOND = "pet care|foods|motors|textiles|dental clinic|book store|software|bakery|hardware|garden supply|travel agency|coffee house".split("|")
LEGAL = {"us": ("Inc", "LLC", "Corp"), "india": ("Pvt Ltd", "Private Limited", "LLP"), "france": ("SARL", "SAS", "EURL")}
STREETS = {"us": ("Main Street", "Oak Avenue", "Park Road"), "india": ("MG Road", "Station Road", "Gandhi Nagar"), "france": ("Rue de la Paix", "Avenue Foch", "Boulevard Voltaire")}
CITIES = {"us": (("Springfield", "IL"), ("Austin", "TX"), ("Salem", "MA")), "india": (("Pune", "Maharashtra"), ("Chennai", "Tamil Nadu"), ("Delhi", "Delhi")), "france": (("Lyon", "Rhône"), ("Paris", "Île-de-France"), ("Lille", "Nord"))}
#: Weights of 0, 1, ... 5 pool copies of a business (fixed values).
COPIES = (0.33, 0.35, 0.18, 0.08, 0.04, 0.02)


def typo(r: random.Random, s: str) -> str:
    """One letter swapped, dropped, doubled or replaced."""
    if len(s) < 4:
        return s
    i = r.randrange(1, len(s) - 1)
    return r.choice((s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + r.choice("abcdefghijklmnopqrstuvwxyz") + s[i + 1 :]))


#: Landmarks that copies in India may add, letters of the Devanagari script by their sound, and the shares of noise (fixed values).
LANDMARKS = ("Near Bus Stand", "Opp City Mall", "Behind Old Temple", "Next to Town Hall")
LETTERS = dict(zip("a b c d e f g h i j k l m n o p r s t u v y".split(), "अ ब क द ए फ ग ह इ ज क ल म न ओ प र स त उ व य".split(), strict=True))
CHAINS, SECOND_NAMES = 0.12, 0.08


def native(s: str) -> str:
    """A word letter by letter in Devanagari; vowels between consonants are left to the reader."""
    low = s.lower()
    return "".join(LETTERS.get(c, "") for k, c in enumerate(low) if k == 0 or c not in "aeiou")


def swapped(r: random.Random, name: str) -> str:
    words = name.split()
    if len(words) > 2:
        k = r.randrange(len(words) - 1)
        words[k], words[k + 1] = words[k + 1], words[k]
    return " ".join(words)


def bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def noisy(r: random.Random, name: str, addr: str, cty: str = "us", second: str | None = None) -> tuple[str, str]:
    """A copy as another source might have it."""
    if second and r.random() < 0.5:
        name = r.choice((second, f"{name} d/b/a {second}"))
    changes = [
        (0.3, lambda n: n.rsplit(" ", 1)[0]),
        (0.15, lambda n: f"{n} {r.choice(LEGAL[cty])}"),
        (0.3, lambda n: typo(r, n)),
        (0.1, lambda n: swapped(r, n)),
        (0.15, lambda n: n.replace(" And ", " & ") if " And " in n else n.replace(" & ", " And ")),
        (0.5 if cty == "france" else 0.0, bare),
        (0.3 if cty == "india" else 0.0, lambda n: " ".join(native(w) if w.isalpha() and r.random() < 0.5 else w for w in n.split())),
        (0.3, lambda n: r.choice((n.upper(), n.lower()))),
    ]
    for share, change in changes:
        if r.random() < share:
            name = change(name) or name
    for long, short in (("Street", "St"), ("Road", "Rd"), ("Avenue", "Ave"), ("Boulevard", "Bd")):
        if r.random() < 0.5:
            addr = addr.replace(long, short)
    parts = addr.split(", ")
    if cty == "india" and r.random() < 0.2 and len(parts[-1]) == 6:
        parts[-1] = f"{parts[-1][:3]} {parts[-1][3:]}"
    for k, share in ((3, 0.3), (2, 0.2), (1, 0.15)):  # postal code, state, city
        if len(parts) > k and r.random() < share:
            parts.pop(k)
    if cty == "india" and r.random() < 0.4:
        parts.insert(1, r.choice(LANDMARKS))
    if r.random() < 0.1:
        parts[0] = typo(r, parts[0])
    if r.random() < 0.1:
        r.shuffle(parts)
    return name, "" if r.random() < 0.02 else ", ".join(parts)


def make(n: int, countries: tuple[str, ...] = ("us", "india"), seed: int = 7) -> tuple[list[tuple], list[tuple], list[tuple], list[tuple]]:
    """(source 1, source 2, source 3, truth) of ``n`` businesses a country, some of them of one chain or with a second name, and of
    look-alikes that are in the pool only; sources are (entity_id, name, address, country)."""
    r = random.Random(seed)
    sources: tuple[list, list, list] = ([], [], [])
    truth = []

    def put(k: int, name: str, addr: str, cty: str) -> str:
        id_ = f"S{k + 1}-{len(sources[k]) + 1:07d}"
        sources[k].append((id_, name, addr, cty))
        return id_

    for cty in countries:
        names: list[str] = []
        for _ in range(n):
            made = f"{r.choice(FIRST).title()} {r.choice(FIRST).title()} {r.choice(SECOND).title()} {r.choice(LEGAL[cty])}"
            name = r.choice(names) if names and r.random() < CHAINS else made
            names.append(name)
            second = f"{r.choice(FIRST).title()} {r.choice(SECOND).title()}" if r.random() < SECOND_NAMES else None
            city, state = r.choice(CITIES[cty])
            code = r.randrange(100000, 999999) if cty == "india" else r.randrange(10000, 99999)
            addr = f"{r.randrange(1, 999)} {r.choice(STREETS[cty])}, {city}, {state}, {code}"
            copies = [put(r.choice((1, 2)), *noisy(r, name, addr, cty, second), cty) for _ in range(r.choices(range(6), COPIES)[0])]
            if r.random() < 0.75:
                truth.append((put(0, name, addr, cty), ",".join(copies)))
            elif r.random() < 0.5:  # a look-alike at another address
                put(r.choice((1, 2)), name, f"{r.randrange(1, 999)} {r.choice(STREETS[cty])}, {city}, {state}", cty)
    return (*sources, truth)


def write(folder: str, split: str, data: tuple[list[tuple], ...]) -> None:
    """The four files of a split."""
    to = Path(folder, split)
    to.mkdir(parents=True, exist_ok=True)
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry"
    for k, rows in enumerate(data[:3], 1):
        (to / f"{split}_source{k}.tsv").write_text("\n".join([head, *("\t".join(x) for x in rows)]) + "\n", encoding="utf-8")
    (to / f"{split}_ground_truth.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *("\t".join(x) for x in data[3])]) + "\n", encoding="utf-8")
