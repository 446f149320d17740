import hashlib
import random
import re
import time

import pytest

from plumbline.llm import pii


def plain(text):
    """The contract's patterns, as written."""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if n % 2 else x for n, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    order = ("email", "ip", "card", "phone")
    return sorted((m.start(), order.index(k), m.end()) for k, m in out)


def test_plain_spans_match_the_patterns():
    r = random.Random(1)
    pieces = ["a", "@", ".", "x.y", "-", "%", " ", "1", "4111 1111 1111 1111", "255", "256", "+", "+49 (0)30 123-4567", "é", "192.168.0.1", "::", "(", "007", "b@c.d"]
    for _ in range(20_000):
        text = "".join(r.choices(pieces, k=r.randrange(1, 14)))
        assert pii.plain_spans(text) == plain(text), text


@pytest.mark.parametrize("text, kind, want", [
    ("write to jane [at] example [dot] org now", 0, "jane [at] example [dot] org"),
    ("write to jane.doe at mail dot example dot org.", 0, "jane.doe at mail dot example dot org"),
    ("аdmin@exаmple.com or", 0, "аdmin@exаmple.com"),
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", 0, "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("call plus four nine one five one two three four five six seven eight ok", 3, "plus four nine one five one two three four five six seven eight"),
    ("host one nine two dot one six eight dot zero dot one up", 1, "one nine two dot one six eight dot zero dot one"),
    ("card four one one one one one one one one one one one one one one one.", 2, "four one one one one one one one one one one one one one one one"),
    ("card 4111​1111 1111 1111", 2, "4111​1111 1111 1111"),
    ("jane(at)example(dot)com", 0, "jane(at)example(dot)com"),
    ("ip 192[.]168[.]0[.]1", 1, "192[.]168[.]0[.]1"),
    ("٤111111111111111 x", 2, "٤111111111111111"),
])
def test_disguises_map_back_to_the_source(text, kind, want):
    base, added = pii.spans(text)
    assert (text.index(want), kind, text.index(want) + len(want)) in base + added
    assert base == plain(text)


@pytest.mark.parametrize("text, kind, want", [
    ("to jоhn@example.com now", 0, "jоhn@example.com"),
    ("to jane@mail.exаmple.com now", 0, "jane@mail.exаmple.com"),
    ("to jane@mail.example [dot] org now", 0, "jane@mail.example [dot] org"),
    ("to +49 30 1234567 eight nine now", 3, "+49 30 1234567 eight nine"),
    ("ip 10.0.0.1​2 now", 1, "10.0.0.1​2"),
])
def test_partial_disguises_reach_beyond_the_plain_span(spark, text, kind, want):
    base, added = pii.spans(text)
    span = (text.index(want), kind, text.index(want) + len(want))
    assert base and base == plain(text) and added == [span]
    assert all(span[0] <= s and e <= span[2] for s, _, e in base)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(docs).first().text == text.replace(want, f"<{pii.KINDS[kind].upper()}>")


def test_every_mix_of_plain_bracketed_and_spoken_signs():
    dots = [".", "[.]", " [dot] ", "(dot)", " dot ", "  DOT "]
    for at in ["@", "[at]", " (at) ", " at ", " AT\n"]:
        for local in ["jane", *(f"john{d}smith" for d in dots)]:
            for one in ["", *dots]:
                for two in dots:
                    want = f"{local}{at}{'mail' + one if one else ''}example{two}com"
                    text = f"écrire: {want}, merci"
                    if at.strip().lower() == "at" and not re.search(r"[(\[]|\sdot\s", want.replace(at, "", 1), re.I):
                        assert pii.spans(text) == ([], [])  # plain speech
                        continue
                    base, added = pii.spans(text)
                    assert base == plain(text)
                    assert (8, 0, 8 + len(want)) in base + added, text
                    assert len(added) == ((8, 0, 8 + len(want)) not in base), text


def test_long_texts_of_marks_take_time_in_proportion():
    for piece in ["a dot ", "a at ", "@ dot a", " at a dot", "a at b.c ", "a@b dot 1 ", "a at b[.]c "]:
        pii.spans(piece * 20_000 + "а")


def test_long_runs_of_blanks_take_time_in_proportion():
    for blank in (" ", "\n", "\t \x0b"):
        for text in ("a [at] b " + blank * 400_000, blank * 400_000 + "[at]", "a at" + blank * 400_000 + "b dot c", "[" + blank * 400_000 + "at",
                     "one dot two" + blank * 400_000, "l0" + blank * 400_000 + "+1"):
            began = time.process_time()
            pii.spans(text)
            assert time.process_time() - began < 5


@pytest.mark.parametrize("text, span", [
    ("host 192 dot 168 dot 0 dot 1.", (5, 1, 28)), ("host 192 dot 168.0 DOT 1", (5, 1, 24)), ("host l92.l68.0.1", (5, 1, 16)),
    ("call +1 2O2 555 O173 now", (5, 3, 20)), ("card 4lll 1111 1111 1111", (5, 2, 24)), ("host l92[.]168 dot O0 dot 1", (5, 1, 27))])
def test_letters_for_digits_and_spoken_dots_of_numbers(text, span):
    base, added = pii.spans(text)
    assert base == plain(text) and span in added


@pytest.mark.parametrize("text", ["version 1 dot 2", "Ol l0 IO 10 1O", "300 dot 1 dot 1 dot 1", "jane @example.com", "O1l Io 0"])
def test_numbers_that_are_nothing_stay_nothing(text):
    assert pii.spans(text) == ([], [])


def test_a_span_inside_a_plain_one_is_not_added():
    text = "card 4111 1111 1111 1111​"
    assert pii.spans(text) == ([(5, 2, 24)], [])


@pytest.mark.parametrize("text", ["He looked at the polka dot dress.", "one two three", "at noon (at) home", "Привет, как дела? О, хорошо", "the one at the two", "see point 3. dot com"])
def test_plain_speech_is_left_alone(text):
    assert pii.spans(text) == ([], [])


def test_query_shape_and_odd_rows(spark):
    rows = [(1, "a@b.cc +49 30 1234567 8"), (2, None), (None, ""), (4, "1" * 50_000 + "@" * 20_000 + "a." * 20_000), (1, "a@b.cc +49 30 1234567 8"), (5, "x [at] y [dot] zz")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_email int, spans string")
    got = pii.find(docs).collect()
    assert len(got) == 6
    by = {str(r.doc_id): r for r in got}
    want = "email:0:6,phone:7:23"
    assert by["1"].spans == want and by["1"].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert by["2"].spans == "" and by["2"].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert (by["5"].n_email, by["5"].n_added, by["5"].spans) == (0, 1, "email:0:17")
    clean = {str(r.doc_id): r.text for r in pii.redact(docs).collect()}
    assert clean["1"] == "<EMAIL> <PHONE>" and clean["2"] is None and clean["5"] == "<EMAIL>"
    assert pii.find(docs.limit(0)).count() == 0
