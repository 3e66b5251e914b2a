"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webquire.queries import QUERIES  # noqa: E402
from webquire.session import local_session  # noqa: E402

HEADLINE = (
    "url_normalize", "url_resolve", "text_word_count", "text_tidy_newlines", "html_tokens", "html_elements",
    "html_main_content", "html_strip_tags", "html_text", "links_extract", "link_edges", "crawl_max_pages", "crawl_bfs",
    "combine_parts", "combine_parts_global", "combine_content", "corpus_by_host", "md_links", "convert_pages",
    "report_items", "stream_first_links",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["url_cache_key"](spark, sf).collect()  # start the JVM's and the workers' engines
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
