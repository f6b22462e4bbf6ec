"""Delegated top-level domains, from the public suffix list that the Java runtime ships.

Spark needs a Java runtime, and that carries the list as a zip archive with one
entry per top-level domain (``lib/security/public_suffix_list.dat``), about
1,450 names, renewed with each Java update.  Where it is missing (some vendors
leave it out) the rule in ``addresses.tld_is_known`` applies; a list of one's own
is a parameter everywhere.
"""

from __future__ import annotations

import os
import re
import shutil
import zipfile
from functools import lru_cache

_FILE = "lib/security/public_suffix_list.dat"


def _java_homes():
    if os.environ.get("JAVA_HOME"):
        yield os.environ["JAVA_HOME"]
    if java := shutil.which("java"):
        yield os.path.dirname(os.path.dirname(os.path.realpath(java)))


@lru_cache(maxsize=1)
def delegated() -> tuple[str, ...]:
    """Names in lower case, sorted; empty if no Java runtime with the list is found."""
    for home in _java_homes():
        path = os.path.join(home, _FILE)
        if os.path.isfile(path) and zipfile.is_zipfile(path):
            with zipfile.ZipFile(path) as archive:
                names = {n.lower() for n in archive.namelist()}
            return tuple(sorted(n for n in names if re.fullmatch(r"[a-z]{2,}|xn--[a-z0-9-]+", n)))
    return ()
