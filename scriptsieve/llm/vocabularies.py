"""Places of the public vocabulary files; the folder is a parameter, and the files are never copied."""

from __future__ import annotations

import os

FOLDER_VARIABLE = "SCRIPTSIEVE_TOKENIZERS"


def path(name: str, folder: str | None = None) -> str:
    folder = folder or os.environ.get(FOLDER_VARIABLE)
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
