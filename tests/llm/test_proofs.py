"""The decoder against every path of its lattice; secrets of forms that the generated findings don't have."""

from __future__ import annotations

import itertools
import random

import numpy as np

from tallyweave.llm import secret_scan, toxicity
from test_operators import DOCS, prose


def test_decoder_is_the_cheapest_of_all_paths():
    text = " ".join(["idiot pathetic stupid trash clown the weather is fine"] * 100)
    counts = np.zeros((toxicity.ALPHABET,) * 3)
    table = toxicity.classes()
    c = table[np.frombuffer(f" {text} ".encode("utf-32-le"), "u4")].astype(int)
    np.add.at(counts, (c[:-2], c[1:-1], c[2:]), 1)
    d = toxicity.Decoder(toxicity.language_model(counts))
    r = random.Random(1)

    def price(word: str) -> float:
        x, y, total = 0, 0, 0.0
        for ch in word:
            z = int(table[ord(ch)])
            total += float(d.costs[x, y, z])
            x, y = y, z
        return total + float(d.costs[x, y, 0])

    for _ in range(150):
        word = "".join(r.choice("idotrashclwn015!$|.-@7") * r.choice([1, 1, 1, 2, 3]) for _ in range(r.randint(1, 5)))
        paths: dict[str, float] = {}
        for arcs in itertools.product(*d.lattice(word)):
            said = "".join(x for x, _ in arcs)
            paths[said] = min(paths.get(said, 1e9), sum(own for _, own in arcs) + price(said))
        got = d.decode(word)
        least = min(paths.values())
        assert abs(got[0][0] - least) < 1e-3, word
        assert all(said in paths and cost >= paths[said] - 1e-3 for cost, said in got)


def test_secrets_of_forms_that_were_not_generated(spark):
    """Precision and recall on held-out forms, of secrets and of look-alikes."""
    r = random.Random(2)
    draw = lambda signs, n: "".join(r.choice(signs) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    b64 = low + up + dig
    secret = [
        lambda: ("export SLACK=", f"xoxb-{draw(dig, 12)}-{draw(b64, 24)}", ""),
        lambda: ("", "sk_live_" + draw(b64, 24), " was left here"),
        lambda: ('{"refreshToken":"', draw(b64, 40), '"}'),
        lambda: ("X-Auth-Token: ", draw("abcdef" + dig, 32), ""),
        lambda: ("//registry/:_authToken=", "npm_" + draw(b64, 36), ""),
    ]
    other = [
        lambda: ("index ", f"{draw('abcdef' + dig, 7)}..{draw('abcdef' + dig, 7)}", " 100644"),
        lambda: ("ISBN ", f"978-{draw(dig, 1)}-{draw(dig, 4)}-{draw(dig, 4)}-{draw(dig, 1)}", ""),
        lambda: ("at ", f"2001:0db8:{draw(dig, 4)}:{draw(dig, 4)}", ""),
        lambda: ('class="', "navigation-sidebar-container-large", '"'),
        lambda: ("see ", f"/usr/share/{draw(low, 6)}/{draw(low, 8)}/{draw(low, 5)}-{draw(dig, 4)}.txt", ""),
        lambda: ("on ", f"{draw(dig, 4)}-{draw(dig, 2)}-{draw(dig, 2)}T{draw(dig, 2)}-{draw(dig, 2)}-{draw(dig, 2)}", ""),
    ]
    rows, planted = [], {}
    for k in range(300):
        a, body, z = r.choice(secret if k % 2 else other)()
        rows.append((k, f"{prose(r, 12)} {a}{body}{z} {prose(r, 8)}"))
        if k % 2:
            planted[k] = body
    out = {x["doc_id"]: x["text"] for x in secret_scan.redact(spark.createDataFrame(rows, DOCS)).collect()}
    masked = {k for k, t in out.items() if secret_scan.MASK in t}
    found = sum(s not in out[k] for k, s in planted.items())
    recall, precision = found / len(planted), len(masked & set(planted)) / max(1, len(masked))
    print(f"recall {recall:.3f} precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9
