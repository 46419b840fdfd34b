"""Settings, decided when a plan is built."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

DEFAULT_NOISE = (r"^page\s+\d+(\s+of\s+\d+)?\s*$", r"^table of contents$", r"^contents$", r"^copyright\s*(©|\(c\))?.*all rights reserved\.?$")
BANNER = r"\b(confidential|proprietary|internal use only)\b"
BANNER_LENGTH = 70
BAD_KEYWORDS = ("updated", "corrected", "release", "initial nda", "revision history", "document revision", "change history", "revision record")
LABELS = {
    "en": {"index": "# Sections", "tree": "## Files", "list": "## Contents by section", "catalog": "# Catalog", "empty": "*Nothing has been stored yet.*", "untagged": "No tag", "uploaded": "added", "diagrams": "###### Figures and the text in them:", "image": "Figure", "text": "Text inside"},
    "zh": {"index": "# 章节", "tree": "## 文件", "list": "## 按章节浏览", "catalog": "# 总目录", "empty": "*尚无文档。*", "untagged": "无标签", "uploaded": "添加于", "diagrams": "###### 图及图中文字：", "image": "图", "text": "图中文字"},
}


@dataclass(frozen=True)
class EngineConfig:
    base_dir: str = field(default_factory=lambda: os.environ.get("SECTIONWISE_BASE_DIR", os.getcwd()))
    locale: str = field(default_factory=lambda: os.environ.get("SECTIONWISE_LOCALE", "en"))
    extra_noise: tuple[str, ...] = ()
    bad_keywords: tuple[str, ...] = BAD_KEYWORDS
    batch_pages: int = 50
    search_limit: int = 100
    #: Folders a stored table is divided into; as many as keep one bucket's files readable at once.
    buckets: int = 16

    def labels(self) -> dict[str, str]:
        return LABELS["zh" if self.locale.lower().startswith("zh") else "en"]

    def noise(self) -> list[str]:
        """Valid patterns; a broken one is logged and left out. Java's engine, which runs them, says what is valid."""
        session = SparkSession.getActiveSession()
        out = list(DEFAULT_NOISE)
        for p in self.extra_noise:
            try:
                if session is None:
                    re.compile(p)
                else:
                    session._jvm.java.util.regex.Pattern.compile(p)
                out.append(p)
            except (re.error, Py4JJavaError, PySparkException):
                logging.getLogger(__name__).warning("pattern left out: %s", p)
        return out
