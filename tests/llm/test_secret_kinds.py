"""Secrets and lookalikes of many kinds, by a recipe of the test's own, not the module's: what is proposed and kept, kind by kind."""

import base64
import hashlib
import random
import uuid
from collections import defaultdict

from hostlens.llm import secrets

rng = random.Random(77)
N = 30
HOSTS = "db.internal cache-2 queue.svc mail.local warehouse".split()
NOUNS = "orders billing invoice parser worker gateway tenant ledger mirror crawler".split()
ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def some(alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def b64(n):
    return base64.b64encode(rng.randbytes(n)).decode()


def jwt():
    return "eyJ" + ".".join(base64.urlsafe_b64encode(rng.randbytes(k)).decode().rstrip("=") for k in (24, 60, 32))


noun, host = lambda: rng.choice(NOUNS), lambda: rng.choice(HOSTS)
SECRETS = {
    "environment file": lambda: (f"{noun().upper()}_API_KEY=%s\nDEBUG=false", some(ABC, rng.randint(24, 44))),
    "yaml password": lambda: (f"  {noun()}:\n    user: svc\n    password: %s\n    port: 5432", some(ABC + "!#$%&*+", rng.randint(12, 20))),
    "json secret": lambda: ('{"clientId": "' + noun() + '", "clientSecret": "%s", "scope": "read"}', b64(24)),
    "connection string": lambda: (f"dsn is postgres://{noun()}:%s@{host()}:5432/main for now", some(ABC, rng.randint(10, 24))),
    "bearer header": lambda: ('curl -H "Authorization: Bearer %s" https://' + host() + "/v1", jwt()),
    "hosting token": lambda: (f"git clone with ghp token %s into {noun()}", "ghp_" + some(ABC, 36)),
    "shell export": lambda: ("export " + noun().upper() + '_TOKEN="%s" && make deploy', some("0123456789abcdef", 40)),
    "code constant": lambda: (f"const {noun()}Secret = '%s';", some(ABC + "-_", 32)),
    "terraform": lambda: ('  secret_key = "%s"\n  region     = "eu-west-1"', some(ABC + "/+", 40)),
}
LOOKALIKES = {
    "commit": lambda: (f"Merge commit %s into {noun()}", hashlib.sha1(rng.randbytes(8)).hexdigest()),
    "checksum": lambda: (f"{noun()}.tar.gz sha256:%s verified", hashlib.sha256(rng.randbytes(8)).hexdigest()),
    "uuid": lambda: ('{"request_id": "%s", "status": 200}', str(uuid.UUID(int=rng.getrandbits(128), version=4))),
    "integrity": lambda: ('"integrity": "sha512-%s"', b64(64)),
    "placeholder": lambda: (f"{noun().upper()}_PASSWORD=%s", rng.choice(["${DB_PASSWORD}", "your_password_here", "<fill-in-later>", "changeme_please", "xxxxxxxxxxxxxxxx"])),
    "variable": lambda: (f"token = %s", rng.choice(["request.headers.authorization", "os.environ['TOKEN']", "settings.SESSION_TOKEN", "get_current_token()", "parser.next_token"])),
    "path": lambda: ("see %s for the rest", "/".join(noun() for _ in range(4)) + f"/v{rng.randint(1, 9)}/handler{rng.randint(1, 99)}"),
    "identifier": lambda: ("the method %s is slow", "".join(noun().title() for _ in range(3)) + f"V{rng.randint(1, 9)}Test"),
    "slug": lambda: ("https://example.org/%s", "-".join(noun() for _ in range(5)) + f"-{rng.randint(1990, 2024)}"),
    "prose": lambda: ("the password: %s for everybody who asks", rng.choice(["something", "everybody", "yesterday", "wonderful", "beautiful"])),
}
#: Kinds that the module's own findings have nothing of.
UNSEEN = {
    "pod": lambda: (f"pod %s restarted twice on {host()}", f"{noun()}-{noun()}-{some('0123456789abcdef', 10)}-{some('bcdfghjklmnpqrstvwxz2456789', 5)}"),
    "branch": lambda: (f"merged branch %s into main", f"feature/{noun().upper()}-{rng.randint(100, 9999)}-{noun()}-{noun()}"),
    "image": lambda: ("![plot](data:image/png;base64,%s)", "iVBORw0KGgoAAAANSUhEUgAA" + b64(60)),
    "file name": lambda: ("attached %s to the mail", f"IMG_{rng.randint(2001, 2024)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}_{rng.randint(0, 235959):06}_{noun()}"),
    "object id": lambda: (f"the {noun()} with objectId %s was deleted", some("0123456789abcdef", 24)),
}


def test_recall_and_removal_by_kind(spark):
    cases = []
    for label, kinds in ((1, SECRETS), (0, LOOKALIKES), (-1, UNSEEN)):
        for kind, make in kinds.items():
            for _ in range(N):
                frame, value = make()
                cases.append((len(cases), frame % value if frame.count("%s") == 1 else frame.replace("%s", value), rng.choice(["src/app", "infra", "notes"]), kind, value, label))
    df = spark.createDataFrame([(i, t, p) for i, t, p, *_ in cases], "doc_id long, text string, source string")
    found = defaultdict(list)
    for r in secrets.scan(df, secrets.train(spark)).collect():
        found[r.doc_id].append((r.candidate, r.kept))
    shares = defaultdict(lambda: [0, 0])
    for i, _, _, kind, value, label in cases:
        hit = [k for c, k in found[i] if c in value or value in c]
        shares[kind, label][0] += bool(hit)
        shares[kind, label][1] += any(hit)
    for (kind, label), (proposed, kept) in shares.items():
        print(f"{('lookalike', 'secret', 'unseen')[label]} {kind}: proposed {proposed / N:.2f}, kept {kept / N:.2f}")
    kept = {label: sum(k for (_, x), (_, k) in shares.items() if x == label) for label in (0, 1, -1)}
    recall, precision = kept[1] / (N * len(SECRETS)), kept[1] / (kept[0] + kept[1])
    unseen = 1 - kept[-1] / (N * len(UNSEEN))
    print(f"recall {recall:.3f}, precision {precision:.3f}, removed of unseen kinds {unseen:.3f}")
    assert recall >= 0.9 and precision >= 0.9 and unseen >= 0.5
