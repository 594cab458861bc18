"""DuckDB SQL for those queries whose every column SQL can express."""

from __future__ import annotations

from . import conversation_trie, mixing, ranked_search, warc

SQL: dict[str, str] = {"op3_mixing": mixing.SQL, "op8_warc": warc.SQL, "op12_conversation_trie": conversation_trie.SQL, "op13_ranked_search": ranked_search.SQL}
