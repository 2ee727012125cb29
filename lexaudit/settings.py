"""Job settings: a frozen dataclass holding the values the operators take."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Mapping

# The default stopword list (one word per line in the original
# configuration file, in file order).
DEFAULT_STOPWORDS: tuple[str, ...] = (
    "こと", "ため", "よう", "これ", "それ", "あれ", "もの", "サイト", "ページ",
    "会社", "情報", "記事", "一覧", "詳細", "内容", "関連", "確認", "利用",
    "株式会社", "お問い合わせ", "ホーム", "トップ", "メニュー", "検索",
    "ログイン", "header", "footer", "nav",
)

# Default URL substrings excluded from collection.
DEFAULT_EXCLUDE_PATTERNS: tuple[str, ...] = ("/tag/", "/category/", "/search")


@dataclass(frozen=True)
class Settings:
    """Values that change what the jobs compute.

    Defaults follow the reference configuration where the value still has a
    meaning for table input (no fetch timing, fonts or file paths).
    """

    max_list_urls: int | None = 50
    include_subdomains: bool = False
    exclude_pdf: bool = True
    respect_robots_txt: bool = True
    prefer_wordpress_api: bool = True
    max_pages: int = 200
    max_depth: int = 3
    exclude_url_patterns: tuple[str, ...] = DEFAULT_EXCLUDE_PATTERNS
    retry_count: int = 2
    user_agent: str = "LexauditBot/1.0"
    min_text_length: int = 100
    include_title: bool = False
    detect_noindex: bool = True
    exclude_noindex_pages: bool = False
    top_n_wordcloud: int = 200
    use_default_stopwords: bool = True
    default_stopwords: tuple[str, ...] = DEFAULT_STOPWORDS
    user_stopwords: tuple[str, ...] = ()
    additional_stopwords_text: str = ""
    compound_mode: bool = True
    forced_compounds: tuple[str, ...] = field(default_factory=tuple)
    forced_compounds_text: str = ""
    save_extracted_text: bool = False

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any]) -> "Settings":
        known = {f for f in cls.__dataclass_fields__}
        kwargs = {}
        for key, value in values.items():
            if key not in known:
                continue
            if isinstance(value, list):
                value = tuple(value)
            kwargs[key] = value
        if "max_list_urls" in kwargs:
            # What is not a whole number is no cap.
            text = str(kwargs["max_list_urls"]).strip()
            kwargs["max_list_urls"] = int(text) if text.lstrip("+-").isdecimal() else None
        if "same_domain_only" in values:
            kwargs["include_subdomains"] = not bool(values["same_domain_only"])
        return cls(**kwargs)

    def with_(self, **changes: Any) -> "Settings":
        return replace(self, **changes)

    @property
    def list_cap(self) -> int | None:
        """The cap of a URL list; none where it is not positive."""
        return self.max_list_urls if (self.max_list_urls or 0) > 0 else None

    def validate(self) -> list[str]:
        errors: list[str] = []
        if int(self.max_pages) <= 0:
            errors.append("max_pages must be positive")
        if int(self.max_depth) < 0:
            errors.append("max_depth must be 0 or more")
        if int(self.retry_count) < 0:
            errors.append("retry_count must be 0 or more")
        if int(self.min_text_length) < 0:
            errors.append("min_text_length must be 0 or more")
        if int(self.top_n_wordcloud) <= 0:
            errors.append("top_n_wordcloud must be positive")
        return errors
