"""Fixed tables: publishers and their aliases, markers, prefectures, programmes, limits."""

from __future__ import annotations


class GateError(ValueError):
    """A snapshot must not replace the published one."""


REGIONS = ["北海道", "東北", "関東", "中部", "近畿", "中国", "四国", "九州"]

# Publisher names as published and the canonical names they stand for.
ALIASES = {
    "経済産業省": "経済産業省", "資源エネルギー庁": "資源エネルギー庁", "中小企業庁": "中小企業庁", "特許庁": "特許庁",
    "情報処理推進機構": "IPA", "独立行政法人情報処理推進機構": "IPA", "IPA": "IPA",
    "国立研究開発法人新エネルギー・産業技術総合開発機構": "NEDO", "新エネルギー・産業技術総合開発機構": "NEDO", "国立研究開発法人NEDO": "NEDO", "NEDO": "NEDO",
} | {f"{prefix}{r}経済産業局": f"{r}経済産業局" for r in REGIONS for prefix in ("", "経済産業省")}

# Names that hold one of these and are no alias are suspicious.
MARKERS = ["経済産業省", "経済産業局", "資源エネルギー庁", "中小企業庁", "特許庁", "情報処理推進機構", "新エネルギー・産業技術総合開発機構", "NEDO", "IPA"]

# Column names of the two bulk files.
COMMON = {"corporate": "法人番号", "name": "商号または名称", "key": "キー情報"}
HEADERS = {
    "subsidy": COMMON | {"date": "証明日", "program": "名称", "amount": "金額", "agency": "発行元", "notes": "対象"},
    "procurement": COMMON | {"date": "受注日", "program": "件名", "amount": "落札価格", "agency": "組織名", "notes": "備考"},
}
OPTIONAL = {"quality": "データ品質", "system": "出典元", "retrieved": "最終取得日", "updated": "最終更新日"}
STAGES = {"subsidy": "subsidy_published", "procurement": "contracted"}
NO_AGENCY = "（発行元なし）"

IDENTITY = ["stage", "sourceKey", "corporateNumber", "publisherCanonical"]
SEMANTIC = [
    "stage", "sourceKey", "organization", "corporateNumber", "sourceAgency", "publisherCanonical", "program", "date",
    "dateRaw", "fiscalYear", "amount", "amountRaw", "notes", "dataQuality", "sourceSystem",
]
PUBLIC = ["id", "fiscalYear", "date", "organization", "corporateNumber", "sourceAgency", "program", "amount", "amountRaw", "stage", "sourceKey", "sourceRowNumber", "sourceSystem"]

# Mark of the bulk source, fields that no published row may have, limits.
INGEST = "gbiz-bulk-csv"
ROUTE_FIELDS = ["route", "flowLevel", "flowDepth"]
PAGE_SIZE, MOST_PAGES, MOST_QUERY = 100, 10_000, 100
ADOPTION_PAGE_SIZE, MOST_ADOPTION_BYTES, MOST_MESSAGE = 20, 1_000_000, 2_000
GROWTH_FLOOR, GROWTH_PERCENT = 1000, 5
CORRECTIONS_MOST, CORRECTIONS_PERMILLE = 100, 2

# Fields of a record that evidence shows, and the notice that an update was stopped.
AUDITED = ["id", "sourceKey", "sourceRowNumber", "organization", "corporateNumber", "sourceAgency", "sourceSystem", "program", "date", "fiscalYear", "amount", "amountRaw", "stage"]
STOPPED = "GビズINFOの自動更新を停止しました。検証済みの前回データを維持し、新しいデータは公開していません。"
STOPPED_FIELDS = ["- 実行: ", "- 検出日時: ", "- 理由: "]
STOPPED_REASON, STOPPED_EVIDENCE = "更新処理失敗", "- 証跡: この実行の `gbiz-source-evidence` artifact"
STOPPED_TABLE, STOPPED_NO_TABLE = "### 訂正候補", "訂正候補の詳細は証跡artifactを確認してください。"
