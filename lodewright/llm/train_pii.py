"""Trains the weights of pii.py on invented texts: python -m lodewright.llm.train_pii

The texts come from a grammar of names, numbers and sentences made here: letters, notes, forms, records and code in
several languages, with words of public vocabularies put in at random. No row of any table is read, and the frames
are not those of any table. tests/llm/ measures the field on texts written apart from these.
"""

from __future__ import annotations

import json
import random
from pathlib import Path

import numpy as np

from lodewright.llm import pii
from lodewright.llm import pii_lexicon as lex

# ---- invented parts


def _syllables(r: random.Random, n: int) -> str:
    onset = ["b", "br", "c", "ch", "d", "dr", "f", "fl", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "qu", "r", "s", "st", "t", "tr", "v", "w", "z"]
    return "".join(r.choice(onset) + r.choice(["a", "e", "i", "o", "u", "ie", "ö", "é", "au"]) for _ in range(n)) + r.choice(["", "n", "r", "s", "ck", "lt", "nd", "m"])


WORDS, NUMBERED = lex.vocabulary(), sorted(lex.NUMBER_CUES - {"at", "after", "before"})
LOW, CAP = sorted(w for w in WORDS.low if w.isascii() and 3 <= len(w) <= 9), sorted(w for w in WORDS.cap if len(w) > 3)


def _surname(r: random.Random) -> str:
    one = lambda: (_syllables(r, r.choice([1, 2, 2, 3])) + r.choice(["", "son", "berg", "well", "ton", "ova", "ski", "man", "ez", "dale", "ström", "field", "escu", "idis", "enko", "sen"])).capitalize()
    kind = r.random()
    if kind < 0.22:
        return r.choice(CAP).capitalize()
    if kind < 0.32:
        return r.choice(LOW).capitalize()
    if kind < 0.36:
        return r.choice(["O'", "D'", "Mc", "Mac"]) + one()
    if kind < 0.42:
        return r.choice(["van der ", "van ", "de ", "von ", "del ", "de la ", "di ", "dos ", "al "]) + one()
    return one() + ("-" + one() if r.random() < 0.1 else "")


_CYRILLIC = ["Иван", "Анна", "Сергей", "Ольга", "Мария", "Павел"], ["Петров", "Иванова", "Соколов", "Кузнецова", "Морозов", "Волкова"]


def _eastern(r: random.Random) -> tuple[str, str]:
    """A text around a name written without blanks, cut at the name, which stands between."""
    han = "".join(r.choice("伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉建文慧欣怡浩宇") for _ in range(r.choice([1, 2])))
    japanese = r.choice(lex.JAPANESE_SURNAMES) + r.choice([" ", ""]) + r.choice(["太郎", "花子", "健一", "美咲", "翔太", "由美", "誠", "恵子"])
    korean = r.choice("김이박최정강조윤장임") + r.choice(["민준", "서연", "지훈", "수빈", "현우", "하은", "지민", "영호"])
    return r.choice(
        [("请联系 \x00 确认", r.choice(lex.HAN_SURNAMES) + han), ("负责人：\x00，电话见下", r.choice(lex.HAN_SURNAMES) + han), ("\x00先生来过", r.choice(lex.HAN_SURNAMES) + han), ("\x00さんに確認", japanese), ("担当: \x00", japanese), ("\x00 씨에게", korean), ("담당자: \x00", korean), ("author \x00 <x>", korean), *[(f, f"{r.choice(_CYRILLIC[0])} {r.choice(_CYRILLIC[1])}") for f in ("Вчера \x00 звонил", "Автор: \x00", "Пришёл \x00", "это \x00")]]
    )


def _name(r: random.Random, lower: bool = True) -> str:
    kind = r.random()
    if kind < 0.03:
        return f"{r.choice(_CYRILLIC[0])} {r.choice(_CYRILLIC[1])}"
    pick = r.random()
    given = r.choice(sorted(lex.GIVEN)).capitalize() if pick < 0.65 else r.choice(CAP).capitalize() if pick < 0.78 else _syllables(r, r.choice([1, 2])).capitalize()
    surname, kind = _surname(r), r.random()
    if kind < 0.5:
        out = f"{given} {surname}"
    elif kind < 0.62:
        out = f"{given} {r.choice('ABCDEFGHJKLMRST')}. {surname}"
    elif kind < 0.66:
        out = f"{given} {r.choice(sorted(lex.GIVEN)).capitalize()} {surname}"
    elif kind < 0.75:
        out = r.choice([f"{given[0]}. {surname}", f"{given[0]}. {surname}", f"{given[0]}.{r.choice('ABCDEFGH')}. {surname}"])
    elif kind < 0.86:
        out = f"{r.choice(['Mr.', 'Ms.', 'Mr', 'Dr.', 'Prof.', 'Frau', 'Herr', 'Mrs', 'Mme', 'Sra.', 'Dr', 'Dame'])} {surname}"
    else:
        out = f"{surname}, {given}"
    style = r.random()
    if style < 0.06:
        return out.upper()
    if style < 0.14 and lower and (kind < 0.5 or kind >= 0.86) and len(surname) > 3 and surname.replace("-", "").isalpha():
        return out.lower()
    return out


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _phone(r: random.Random) -> str:
    d = lambda n: _digits(r, n)
    area = r.choice("23456789") + d(2)
    return r.choice(
        [f"+1-{area}-555-{d(4)}", f"({area}) 555-{d(4)}", f"{area}.555.{d(4)}", f"{area}-555-{d(4)}", f"{area} 555 {d(4)} ext. {d(2)}", f"+1{area}555{d(4)}", f"tel:+44{d(10)}", f"+44 20 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"0044 {d(4)} {d(6)}", f"+49 {d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(5)}-{d(3)}", f"(0{d(2)}) {d(5)} {d(3)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"+81 3-{d(4)}-{d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+55 {d(2)} 9{d(4)}-{d(4)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"0{d(2)} {d(6)}", f"0{d(3)} {d(3)} {d(4)}", f"+91 {d(5)} {d(5)}", f"+86 1{d(2)} {d(4)} {d(4)}", f"{area}-555-{d(4)} x{d(3)}", f"({area}) 555 {d(4)}", f"+7 {d(3)} {d(3)}-{d(2)}-{d(2)}"]
    )


def _id(r: random.Random) -> tuple[str, str]:
    """(label, number); the label may be empty where the number speaks for itself."""
    d, u = (lambda n: _digits(r, n)), (lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n)))
    return r.choice(
        [("", f"{d(3)}-{d(2)}-{d(4)}"), (r.choice(["SSN ", "SSN: ", "social security number ", "Social Security No. "]), r.choice([f"{d(3)} {d(2)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}"])), (r.choice(["ssn=", "SSN:", '"ssn": '] ), d(9)), (r.choice(["", "NI number ", "National Insurance: "]), r.choice([f"{u(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{u(2)}{d(6)}{r.choice('ABCD')}"])), (r.choice(["Steuer-ID ", "tax id ", "Steuer-ID: ", "IdNr "]), r.choice([f"{d(2)} {d(3)} {d(3)} {d(3)}", d(11)])), (r.choice(["DNI ", "", "NIF: "]), r.choice([f"{d(8)}-{u(1)}", f"{d(8)}{u(1)}"])), (r.choice(["NIE ", "NIE: "]), f"{r.choice('XYZ')}{d(7)}-{u(1)}"), (r.choice(["passport number ", "passport no. ", "Passport: ", "Reisepass ", "pasaporte ", "passeport n° "]), r.choice([f"{u(1)}{d(8)}", f"{u(2)}{d(7)}", f"{u(1)}{d(7)}", d(9)])), (r.choice(["driver's licence ", "driving license ", "licence no. ", "driver license: "]), r.choice([f"{u(2)}-{d(4)}-{d(3)}", f"{u(1)}{d(7)}", f"{u(1)}{d(3)}-{d(4)}-{d(4)}"])), (r.choice(["national id ", "identity number ", "ID card ", "personnummer "]), r.choice([f"{d(6)}-{d(4)}", f"{d(8)}-{d(4)}", f"{u(2)}{d(6)}", d(11)])), (r.choice(["CPF ", "CPF: ", "cpf=", ""]), f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"), (r.choice(["Aadhaar ", "aadhaar number ", "Aadhaar: "]), f"{d(4)} {d(4)} {d(4)}"), (r.choice(["PESEL ", "PESEL: ", "BSN "]), r.choice([d(11), d(9)])), (r.choice(["", "codice fiscale "]), f"{u(6)}{d(2)}{u(1)}{d(2)}{u(1)}{d(3)}{u(1)}"), (r.choice(["SIN ", "TFN "]), r.choice([f"{d(3)}-{d(3)}-{d(3)}", f"{d(3)} {d(3)} {d(3)}"])), (r.choice(["NIR ", "n° de sécurité sociale "]), f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}"), (r.choice(["NHS number ", "NHS no. "]), f"{d(3)} {d(3)} {d(4)}"), (r.choice(["CURP ", ""]), f"{u(4)}{d(6)}{u(6)}{d(2)}")]
    )


def _address(r: random.Random) -> str:
    word = lambda: r.choice(LOW + CAP).capitalize() if r.random() < 0.4 else _syllables(r, r.choice([1, 2])).capitalize() + r.choice(["", "wood", "gate", "field", "hill"])
    number, town = r.randrange(1, 260), word()
    kind = r.random()
    if kind < 0.5:
        street = f"{number} {r.choice(['', '', 'Old ', 'North '])}{word()} {r.choice(['Street', 'St', 'Road', 'Rd', 'Avenue', 'Ave', 'Lane', 'Drive', 'Court', 'Ct', 'Close', 'Terrace', 'Mews', 'Way', 'Place'])}"
        if r.random() < 0.15:
            street = f"Flat {r.randrange(1, 20)}, " + street
        elif r.random() < 0.15:
            street += f", Apt {r.randrange(1, 20)}{r.choice('ABC')}"
        return (street + (f", {town}" if r.random() < 0.5 else "")) if r.random() < 0.9 else street.lower()
    if kind < 0.64:
        return f"{number}{r.choice(['', ' bis', ' ter', ''])}, rue {r.choice(['de la ', 'du ', 'des ', ''])}{word()}" + (f" {word()}" if r.random() < 0.3 else "") + (f", {town}" if r.random() < 0.6 else "")
    if kind < 0.78:
        street = r.choice([f"{word()}{r.choice(['straße', 'weg', 'allee', 'gasse'])}", f"Am {word()}"])
        return f"{street} {number}" + (f", {_digits(r, 5)} {town}" if r.random() < 0.7 else "")
    if kind < 0.89:
        street = r.choice([f"via {word()}", f"Via {word()} {word()}", f"Piazza {word()}", f"Rua {r.choice(['das ', 'do ', ''])}{word()}", f"{word()}straat", f"{word()}gatan", f"{word()}laan", f"ul. {word()}", f"ул. {r.choice(['Ленина', 'Садовая', 'Мира'])}", f"Carrer {word()}", f"{word()} Straße"])
        return f"{street} {number}" + (f", {r.choice(['', _digits(r, 5) + ' ', _digits(r, 2) + '-' + _digits(r, 3) + ' '])}{town}" if r.random() < 0.5 else "")
    return f"Calle {r.choice(['de la ', 'del ', ''])}{word()}" + (f" {word()}" if r.random() < 0.5 else "") + f" {number}" + (f", {r.randrange(1, 9)}º {r.choice('ABC')}" if r.random() < 0.6 else "") + (f", {town}" if r.random() < 0.6 else "")


def _email(r: random.Random) -> str:
    local = r.choice([f"{_syllables(r, 1)}.{_syllables(r, 2)}", f"{_syllables(r, 2)}{_digits(r, 2)}", f"{_syllables(r, 1)}+{_syllables(r, 1)}", f"{_syllables(r, 1)}_{_syllables(r, 2)}", f"{_syllables(r, 1)}-{_syllables(r, 1)}"])
    local = "".join(c for c in local if c.isascii())
    host = ".".join("".join(c for c in _syllables(r, r.choice([1, 2])) if c.isascii()) for _ in range(r.choice([1, 1, 2]))) + r.choice([".com", ".org", ".net", ".example", ".test", ".de", ".co.uk"])
    style = r.random()
    if style < 0.08:
        return f"{local} [at] {host.replace('.', ' [dot] ')}"
    if style < 0.14:
        return f"{local} (at) {host}"
    if style < 0.2:
        return f"{local}%40{host}"
    if style < 0.25:
        return f"{local} at {host.replace('.', ' dot ')}"
    return f"{local}@{host}".upper() if style < 0.36 else f"{local}@{host}"


#: Sentences and records with a place for a mention. {} is one of the kind, {name} and {id} are others beside it.
_FRAMES = {
    "person_name": ["{}", "Dear {},", "Kind regards\n{}", "From: {} <{mail}>", "Signed: {}", "{} will join us on Tuesday.", "Our guest, {}, arrives late.", "The book by {} came today.", "Lieber {}, vielen Dank.", "Mit freundlichen Grüßen\n{}", "Estimada {}:", "Gracias, {}", "Bonjour {}, voici le plan.", "Meeting with {} at noon", "She married {} in June.", "{} and {name} disagree.", "Passenger: {}", "name: {}", "\"name\": \"{}\"", "user,{},active", "{};12;open", "| {} | 2 |", "- {}: buy milk", "{} (director)", "{} ({id})", "@param owner {}", "# {} <{mail}>", "what did {} mean?", "{}'s car", "I spoke to {} about it", "room booked for {}", "Invited: {}, {name}", "the letter to {} was returned", "said {}.", "we owe {} an answer", "<li>{}</li>", "{} - 14:00", "attendee={}&seat=4", "[{}] joined", "Copyright {}", "Patient {} was moved", "for {}, again", "Herr Nachbar, das ist {}.", "il dottore {} arriva", "{}: yes, that works", "until {} is back", "{} lives here", "hired {} last year", "teacher {}", "TODO({}): clean up", "my name is {}", "the author, {}, agreed", "Could {} come earlier?", "Has {} replied?", "Yesterday {} left early", "When {} called, it rained", "Then {} sat down", "Although {} knows", "owner: {}", "name={};", "{};{mail};x", "user {} logged in", "the driver {} waits"],
    "email": ["{}", "Please write to {}.", "E-Mail: {}", "mailto:{}", "<{}>", "\"email\": \"{}\"", "contact={}&x=1", "reply-to: {};", "send the form to {} before noon", "{},active,2", "Schreiben Sie an {}", "escribe a {}", "my address is {}", "cc {}, {name}", "From: {name} <{}>", "{} unsubscribed", "| {} |", "account {} is locked", "newsletter ({})", "forwarded by {}", "<a href=\"mailto:{}\">", "To: {}", "no answer from {} yet", "login {} failed", "{} / {phone}"],
    "phone": ["{}", "Phone: {}", "Tel. {}", "Call {} after six.", "you can reach us at {}", "my mobile is {}", "Fax {}", "\"phone\": \"{}\"", "phone={}&x=1", "{name}, {}", "| {} |", "WhatsApp {}", "Telefon: {}", "llámame al {}", "Rufen Sie {} an.", "{} (home)", "text {} when you land", "the number {} is not in service", "{},home", "office {}, room 4", "tel:{}", "dial {} for help", "emergency: {}", "{mail} / {}", "no one answers at {}", "{} rang twice", "contact {} today", "hotline {} opens at nine", "left a voicemail at {}", "is {} your number?", "<b>{}</b>", "{};x"],
    "id_number": ["{}", "My {} is on the card.", "({})", "{name}, {}", "{name} ({})", "form: {}", "\"{}\"", "| {} |", "copy of {} attached", "the clerk typed {} twice", "please delete {} from the file", "{};x", "who has {}?", "verified {} today", "document {} expires soon", "born 1980, {}", "applicant {}", "{}, issued in May", "record with {} was shared", "[{}]", "hide {} in the export", "they asked for {} at the desk"],
    "street_address": ["{}", "We moved to {}.", "Address: {}", "Send it to {}", "{name}\n{}", "{name}, {}", "\"address\": \"{}\"", "addr={};", "| {} |", "the house at {} is for sale", "Anschrift: {}", "vive en {}", "meet me at {} tomorrow", "the shop is at {}, next door", "delivered to {} on Friday", "{}; second floor", "visit us: {}", "abita in {}", "from {} it is a short walk", "my aunt lives at {}", "park near {}", "{} is closed", "the parcel for {} is lost", "headquarters: {}", "7,{},x"],
}


def _nothing(r: random.Random) -> str:
    """Text without any mention: prose, headings, numbers of all kinds, code."""
    d = lambda n: _digits(r, n)
    word, cap, low = (lambda: r.choice(LOW)), (lambda: r.choice(CAP).capitalize()), (lambda: _syllables(r, 2))
    title = lambda n: " ".join(word().capitalize() for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    given, noun = r.choice(sorted(lex.GIVEN)), r.choice(["Theorem", "Filter", "Algorithm", "Chain", "Tree", "Process", "Order", "Curve", "Number", "Test", "Model", "Street", "Award", "Airport", "Islands"])
    if r.random() < 0.12:  # a number said to be something else
        shape = r.choice([f"{d(5)}-{d(2)}-{d(5)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(2)}.{d(3)}.{d(4)}", d(9), d(10), f"{d(3)} {d(3)} {d(3)}", f"{d(4)}-{d(4)}-{d(4)}", f"{d(2)}-{d(7)}", f"0{d(4)}-{d(2)}-{d(5)}", f"0{d(9)}", f"{d(3)}-{d(2)}-{d(4)}x"])
        cue = r.choice(NUMBERED)
        return f"{r.choice([cue, cue.capitalize()])}{r.choice([' ', ' ', ': ', '=', ' #'])}{shape}{r.choice(['', ' ' + word(), '.'])}"
    return r.choice(
        [
            f"The {title(r.choice([2, 2, 3]))} is {word()}", f"{title(r.choice([2, 3, 4]))}", f"{title(2)}: {word()} {word()}", f"Use the {title(2)} {word()} {word()}", f"the {title(2)} of {cap()}", f"{cap()} {title(1)} and {title(2)} {word()}",
            f"The {cap()} {noun} {word()} {word()}", f"a {cap()} {noun}", f"{cap()} {noun} or {title(2)}", f"{title(1)} {cap()}", f"in {cap()} {title(1)} {word()}", f"flights to {cap()} and {cap()}", f"{cap()}, {cap()} and {cap()}", f"{word()} {word()} {word()} {word()}",
            f"{r.choice(sorted(lex.CLOSINGS)).capitalize()}, {r.choice([_surname(r), given.capitalize()])}", f"{low()} {low()} {word()}", f"{word()} {low()} {low()}", f"{word()} {low()}", f"{given.capitalize()} {word()} {word()}", f"{given} the {word()}", f"{given} {word()} {word()} it", f"{given.capitalize()}, can you {word()} it?", f"Hi {given.capitalize()}", f"{title(1)} {given.capitalize()} {word()}",
            f"{r.choice(['Monday', 'Friday', 'In May', 'Until June'])} {cap()} {word()}", f"{word().capitalize()} {low().capitalize()} for {low()} {word()}", f"{low().capitalize()} {word()}", f"{low().capitalize()}{title(1)} {title(1)} {word()}", f"{word().upper()} {word().upper()} {word().upper()}", f"{word().upper()} {low()}: {title(2)}", f"{word()}.{low()}.{word()}()",
            f"order {d(7)} shipped", f"{word()} {d(5)}-{d(2)}-{d(5)} {word()}", f"version {d(2)}.{d(3)}.{d(4)} {word()} {d(2)}.{d(3)}.{d(4)}", f"build {d(7)}-{d(2)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"IBAN {r.choice(['DE', 'GB', 'FR', 'ES'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"IBAN {r.choice(['DE', 'NL'])}{d(20)}", f"card {d(4)} {d(4)} {d(4)} {d(4)}", f"P.O. Box {d(3)}", f"Postfach {d(4)}",
            f"10.{d(2)}.{d(3)}.{d(2)}:{d(4)} {word()}", f"192.168.{d(2)}.{d(2)}", f"commit {hexa(r.choice([7, 10, 40]))}", f"{word()} {d(10)}.", f"{word()} {d(10)}?", f"{d(4)}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}", f"{d(4)}-{d(2)}-{d(2)}T{d(2)}:{d(2)}:{d(2)}.{d(6)}Z", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{hexa(8)}-{hexa(4)}-4{hexa(3)}-9{hexa(3)}-{hexa(12)}", f"{d(3)},{d(3)},{d(3)} {word()}", f"{d(1)}.{d(3)}.{d(3)} {word()}", f"took {d(3)} {d(3)} {d(2)} ns", f"ticket {d(3)}-{d(3)}-{d(4)}x", f"ref. {d(3)}/{d(4)}/{d(2)}", f"invoice {d(4)}-{d(6)}", f"{d(2)} {word()}, {d(2)} {word()} in {d(2)}.{d(1)}s", f"@@ -{d(2)},{d(2)} +{d(2)},{d(2)} @@", f"{hexa(7)}..{hexa(7)} {word()}", f"lat {d(2)}.{d(6)}, lon {d(2)}.{d(6)}", f"price {d(4)}.{d(2)}",
            f"git@{low()}.example:{low()}/{low()}.git", f"ssh://git@{low()}.example/{low()}.git", f"{low()}@{r.randrange(9)}.{r.randrange(20)}.{r.randrange(9)} {word()}", f"npm i @{low()}/{low()}@1.{d(1)}.{d(1)}", f"https://{word()}@{low()}.example/x", f"@{word()} {word()}", f"{word()} at {low()}.{word()}", f"looks fine at {low()}.{word()}.com", f"root@{low()}:~#", f"{word()} at line {d(2)} in {low()}/{low()}.py", f"{low()}@{d(2)}.{d(2)}.{d(1)}.{d(1)}",
            f"{d(2)} {title(1)} {word()} and {d(2)} {title(1)} {word()}", f"{d(2)} {title(1)} {r.choice(['Drive', 'Close', 'Court', 'Way', 'Place', 'Road'])} {word()}", f"{d(2)} {r.choice(['Drive', 'Close', 'Court', 'Way', 'Place'])} {word()} {word()}", f"{d(2)} {word()} {r.choice(['drive', 'way', 'place', 'court', 'close', 'row'])} {word()}", f"line {d(2)} {word()} way {word()}", f"via {word()} {d(1)}", f"via {low()} {word()}", f"am {word()} {d(2)}", f"im {word().capitalize()} {d(4)}", f"step {d(1)}: {word()} {d(2)} {word()} {word()}", f"Section {d(1)}.{d(1)} {title(2)}", f"Chapter {d(2)} {title(2)}", f"{d(2)} {word()}", f"{title(1)} {d(2)} {title(1)} {word()}",
            f"Sie {r.choice(['den', 'die', 'das', 'dem'])} {cap()} {word()}", f"die {cap()} und das {cap()}", f"für {cap()} und den {cap()}", f"im {cap()} der {cap()}", f"IBAN GB{d(2)} {''.join(r.choice('ABCDEFGH') for _ in range(4))} {d(4)} {d(4)} {d(4)} {d(2)}", f"in {cap()} {title(1)} {word()} {word()}", f"the {cap()} {cap()} {word()}",
            "请 检查 日志 和 配置", "我们明天再看高度的问题", "王国的历史很长", "任何问题都可以", "会議は中止です", "東京と大阪の間", "이것은 문서의 제목입니다", "정보 조회 오류", f"import {low()}, {low()}", f"def {low()}_{word()}(self, {word()}):", f"raise {low().capitalize()}Error({word()})", f"{word().capitalize()} {word()} {word()}. {word().capitalize()} {word()} {cap()}.",
        ]
    )


def invent(r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A text and its mentions (start, end, type number)."""
    text, gold = "", []
    for k in range(r.choice([1, 1, 2, 3, 4])):
        if k:
            text += r.choice([". ", " ", "\n", "; ", "\n", ", "])
        if r.random() < 0.45:
            text += _nothing(r)
            continue
        if r.random() < 0.02:
            frame, value = _eastern(r)
            left, right = frame.split("\x00")
            gold.append((len(text) + len(left), len(text) + len(left) + len(value), 4))
            text += left + value + right
            continue
        kind = r.choice(list(_FRAMES))
        frame = r.choice(_FRAMES[kind])
        for piece in [p for p in frame.replace("{", "\x03{").replace("}", "}\x03").split("\x03") if p]:
            slot = {"{}": kind, "{name}": "person_name", "{id}": "id_number", "{mail}": "email", "{phone}": "phone"}.get(piece)
            if slot is None:
                text += piece
                continue
            if slot == "id_number":
                label, value = _id(r)
                text += label
            else:
                value = {"person_name": _name, "email": _email, "phone": _phone, "street_address": _address}[slot](r)
            gold.append((len(text), len(text) + len(value), pii.TYPES.index(slot)))
            text += value
    return text, gold


# ---- maximum likelihood over the lattice of candidates


def lattices(n: int, seed: int):
    """Training lattices: per text the candidates' spans, feature rows and which of them are gold; the names of features; the share of mentions that no candidate covers."""
    r, out = random.Random(seed), []
    names: dict[str, int] = {}
    missed = total = 0
    for _ in range(n):
        text, gold = invent(r)
        found = pii.candidates(text)
        where = set(gold)
        missed += len(where - {(a, b, t) for a, b, t, _ in found})
        total += len(where)
        rows = [[names.setdefault(x, len(names)) for x in f] for *_, f in found]
        out.append(([(a, b, t) for a, b, t, _ in found], rows, [(a, b, t) in where for a, b, t, _ in found]))
    return out, names, missed / max(total, 1)


def _expected(spans, scores, step=None):
    """(log partition, marginal of each candidate, expected transitions) over all segmentations without overlaps; step[l, t] weighs a mention of type t after one of type l."""
    n, none = len(spans), len(pii.TYPES)
    step = np.zeros((none + 1, none)) if step is None else step
    before = []
    for i in range(n):
        j = i
        while j > 0 and spans[j - 1][1] > spans[i][0]:
            j -= 1
        before.append(j)
    alpha, beta = np.full((n + 1, none + 1), -np.inf), np.full((n + 1, none + 1), -np.inf)
    alpha[0, none] = 0.0
    for i in range(n):
        t = spans[i][2]
        alpha[i + 1] = alpha[i]
        alpha[i + 1, t] = np.logaddexp(alpha[i, t], np.logaddexp.reduce(alpha[before[i]] + step[:, t]) + scores[i])
    beta[n] = 0.0
    for i in range(n - 1, -1, -1):
        t = spans[i][2]
        beta[i] = np.logaddexp(beta[i], beta[i + 1])
        beta[before[i]] = np.logaddexp(beta[before[i]], beta[i + 1, t] + scores[i] + step[:, t])
    whole = np.logaddexp.reduce(alpha[n])
    marginal, moves = np.zeros(n), np.zeros_like(step)
    for i in range(n):
        t = spans[i][2]
        p = np.exp(alpha[before[i]] + step[:, t] + scores[i] + beta[i + 1, t] - whole)
        marginal[i] = p.sum()
        moves[:, t] += p
    return whole, marginal, moves


def train(n: int = 14_000, seed: int = 7, epochs: int = 7, rate: float = 0.1, decay: float = 1e-4) -> dict[str, float]:
    data, names, _ = lattices(n, seed)
    none = len(pii.TYPES)
    w, square, r = np.zeros(len(names)), np.full(len(names), 1e-6), random.Random(seed)
    step_w, step_square = np.zeros((none + 1, none)), np.full((none + 1, none), 1e-6)
    for _ in range(epochs):
        r.shuffle(data)
        for spans, rows, gold in data:
            if not spans:
                continue
            scores = np.array([w[x].sum() for x in rows])
            _, marginal, moves = _expected(spans, scores, step_w)
            step = np.zeros_like(w)
            for row, g, m in zip(rows, gold, marginal):
                np.add.at(step, row, g - m)
            step -= decay * w
            square += step * step
            w += rate * step / np.sqrt(square)
            last = none
            for span, g in zip(spans, gold):
                if g:
                    moves[last, span[2]] -= 1
                    last = span[2]
            change = -moves - decay * step_w
            step_square += change * change
            step_w += rate * change / np.sqrt(step_square)
    out = {k: round(float(w[i]), 4) for k, i in sorted(names.items()) if abs(w[i]) >= 0.005}
    return out | {pii.transition(a, b): round(float(step_w[a, b]), 4) for a in range(none + 1) for b in range(none)}


def main() -> None:
    w = train()
    path = Path(__file__).with_name("pii_weights.json")
    path.write_text(json.dumps(w, indent=0, sort_keys=True) + "\n")
    r, right, said, true = random.Random(99), 0, 0, 0
    for _ in range(2000):
        text, gold = invent(r)
        got, want = {(a, b, pii.TYPES.index(t)) for a, b, t in pii.mentions(text, w)}, set(gold)
        right, said, true = right + len(got & want), said + len(got), true + len(want)
    print(f"{len(w)} weights; held out: precision {right / said:.4f}, recall {right / true:.4f}")


if __name__ == "__main__":
    main()
