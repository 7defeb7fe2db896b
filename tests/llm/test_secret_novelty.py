"""What the novelty of strings finds and leaves alone, by alphabet and by kind of name."""

import random
import string

import pytest

from rolefit.llm import secret_scan

WORDS = """time year people way day man thing woman life child world school state family student group country problem hand part
place case week company system program question work government number night point home water room mother area money story fact
month lot right study book eye job word business issue side kind head house service friend father power hour game line end member
law car city community name president team minute idea body information back parent face others level office door health person
art war history party result change morning reason research girl guy moment air teacher force education value config request
client server model controller handler manager session account user order payment invoice report search index cache queue worker
task event message channel stream buffer parser lexer token render widget layout theme style image video audio network socket
packet router proxy gateway cluster node storage volume backup restore archive import export update delete create insert select
filter mapper reducer combine merge split sort rank score weight metric counter timer logger debug error warning notice trace""".split()
KNOWN, UNKNOWN = WORDS[::2], WORDS[1::2]
ALPHABETS = {
    "upper": string.ascii_uppercase, "lower": string.ascii_lowercase, "digits": string.digits, "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF",
    "base32": string.ascii_uppercase + "234567", "alphanumeric": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/",
}


@pytest.fixture(scope="module")
def novelty():
    return secret_scan.Novelty(" ".join(KNOWN).encode(), 3, 0.8)


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_strings(novelty, name):
    draw = random.Random(name)
    for n in (16, 20, 24, 31, 32, 33, 40, 64, 100, 200):
        strings = ["".join(draw.choices(ALPHABETS[name], k=n)) for _ in range(100)]
        for before in ("Authorization: Bearer ", "auth see ", "some token value for the client is "):
            found = sum(novelty.spans(f"{before}{s} and more") == [(len(before), 3, len(before) + n)] for s in strings)
            assert found >= 90, (before, n, found)


@pytest.mark.parametrize("words", [KNOWN, UNKNOWN], ids=["known", "unknown"])
def test_paths_and_names(novelty, words):
    draw = random.Random(5)

    def number(most):
        return draw.choice(["", str(draw.randint(0, most))])

    kinds = {
        "path": lambda: "/" + "/".join(draw.choice(words) + number(99) for _ in range(draw.randint(3, 7))) + draw.choice([".py", ".json", ""]),
        "host": lambda: ".".join(draw.choice(words) + number(9) for _ in range(draw.randint(3, 4))) + draw.choice([".com", ".org", ".internal"]),
        "identifier": lambda: "_".join(draw.choice(words) for _ in range(4)),
        "camel": lambda: "".join(draw.choice(words).capitalize() for _ in range(4)),
    }
    for kind, make in kinds.items():
        names = [x for x in (make() for _ in range(400)) if len(x) >= 16]
        for before in ("auth see ", "the token "):
            found = [x for x in names if novelty.spans(f"{before}{x} and more")]
            assert len(found) <= 0.02 * len(names), (kind, len(found), found[:5])


def test_a_repeated_string_is_not_new_again(novelty):
    string_ = "Zk3v9QxT7bLm2RwYp8Hd"
    text = f"token {string_} then {string_}"
    assert novelty.spans(text) == [(6, 3, 26)]


def test_no_dictionary():
    novelty = secret_scan.Novelty(b"", 3, 0.8)
    assert novelty.names.known("authentication") == 0 and novelty.spans("auth " + "a" * 40) == []
