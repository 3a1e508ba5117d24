"""Fixed values.

Everything in this file is data, not logic: the words, patterns, formats, labels and limits that
captured records are written with and that results must reproduce exactly. Patterns are written for
Java regular expressions; an ASCII word boundary is spelled ``(?<![A-Za-z0-9_])`` / ``(?![A-Za-z0-9_])``
because Java's ``\\b`` treats CJK letters as word characters.
"""

# --- fixed values: character classes -------------------------------------------------------------
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WS_CHARS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOT_AFTER_WORD = r"(?<![A-Za-z0-9_])"
NOT_BEFORE_WORD = r"(?![A-Za-z0-9_])"
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
LINE_BREAK = r"\r?\n"
#: Unicode's space separators (Zs).
SPACE_SEPARATORS = " \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u202f\u205f\u3000"
SENTENCE_BREAK = r"\r?\n|(?<=[。！？])\s*"
LIST_MARK = rf"^{WS}*(?:#{{1,6}}|[-*]|\d+\.){WS}*"
UNIT_MARK = rf"^{WS}*(?:#{{1,6}}|[-*+]{WS}+|\d+\.{WS}+)"
COPY_SUFFIX = rf"{WS}*\((?:[2-9]|\d{{2,}})\){WS}*$"

# --- fixed values: event kinds and ranks ---------------------------------------------------------
TASK_KINDS = ["task_started", "task_progress", "task_completed", "task_blocked"]
ACTIVITY_KINDS = TASK_KINDS + [
    "research_activity", "output_created", "knowledge_created", "knowledge_updated", "knowledge_reused",
]
KNOWLEDGE_KINDS = ["knowledge_created", "knowledge_updated"]
KIND_PRIORITY = {"task_blocked": 4, "task_completed": 3, "task_progress": 2, "task_started": 1}
LABEL_PRIORITY = [("codex", 3.0), ("feishu", 2.5), ("wiki", 2.0), ("git", 1.0)]
SETTLEMENT_PRIORITY = {"failed": 4, "pending": 3, "succeeded": 2, "not-applicable": 1}
SETTLEMENT_STATUSES = ["succeeded", "pending", "failed", "not-applicable"]
RUN_STATUSES = ["running", "idle", "succeeded", "partial", "failed", "unknown"]
PROOF_CONFIDENCE = {"independent": "verified", "target-present": "observed", "report-only": "reported"}
CAPTURE_REF_TYPES = ["codex", "chatgpt", "feishu"]

# --- fixed values: limits ------------------------------------------------------------------------
TASK_COPY_GAP_DAYS = 14
FOCUS_GAP_MINUTES = 90
COMMIT_FILES_SHOWN = 8
STALE_HOURS = 36
QUIET_HOURS = 2
RECENT_HOURS = 48
RETRY_BACKOFF_HOURS = 12
RETRY_BACKOFF_CAP_HOURS = 72
SELECTION_TOPICS, SELECTION_PAIRS, SELECTION_CHARS = 6, 40, 120_000
SYNC_OVERLAP_MINUTES, SYNC_FIRST_DAYS, SYNC_AHEAD_DAYS = 60, 30, 30
AUTOMATION_RESULT_CHARS = 2000
QUEUE_EVENTS, QUEUE_CHARS = 2000, 4_000_000
SCAN_CANDIDATES, SCAN_ATTEMPTS, SCAN_CHILDREN, SCAN_REPOSITORIES = 32, 64, 16, 12
VERIFIED_PRODUCER_MAJOR, VERIFIED_PRODUCER_MINORS = 0, [144, 147]
AUTOMATIC_WINDOW = ("23:25", "23:35")

# --- fixed values: prompt and status patterns ----------------------------------------------------
AUTOMATION_PROMPT = r"(?i)<heartbeat>|<automation_id>|Automation ID:"
AUTOMATION_HEADER = rf"(?i)^{WS}*(?:<heartbeat>|Automation(?: ID)?{WS}*:)"
OPT_OUT_PROMPT = rf"(?i)^{WS}*\[no-obsidian\]"
SUGGESTION_PREFIX = "# Overview\nGenerate 0 to 3 hyperpersonalized suggestions"
SUGGESTION_PROMPT = rf"(?i)^{WS}*# Overview{WS}+Generate 0 to 3 hyperpersonalized suggestions(?![A-Za-z0-9_])"
DELEGATION_INPUT = r"(?i)<codex_delegation>[\s\S]*?<input>([\s\S]*?)</input>[\s\S]*?</codex_delegation>"
BROWSER_COMMENTS_PREFIX = "# Browser comments:"
BROWSER_COMMENT = (
    r"(?im)^Comment:\s*\r?\n([\s\S]*?)"
    r"(?=^## Comment|^<in-app-browser-context|^## My request for Codex:|\s*$)"
)
REQUEST_MARKER = "## My request for Codex:"
AMBIENT_OPEN = "<in-app-browser-context"
AMBIENT_BLOCK = r"(?i)<in-app-browser-context[\s\S]*?</in-app-browser-context>"
MENTIONED_FILES_BLOCK = r"(?im)^# Files mentioned by the user:[\s\S]*?## My request for Codex:"
NO_OP_RESULT = (
    "收件箱为空|队列为空|无新增|暂无新增|暂无反馈|暂无待办|未发现新增|没有新的|没有待处理|没有可处理|无需用户操作|"
    "状态无新增变化|状态与上次一致|本轮未领取任何工单|本轮无新增处理结果"
)
DURABLE_RESULT = (
    r"(?i)(?:日报|早报|工作日志).{0,24}(?:已生成|已发送|已写入)|已写入.{0,24}(?:日报|日志)|message_id|日志\s*ID|"
    r"记录\s*rec[a-z0-9]+|(?:创建|更新|关闭|处理|回复).{0,16}(?:Issue|工单|反馈)|"
    r"(?:Issue|工单|反馈).{0,16}(?:已创建|已更新|已关闭|已处理|已回复)|commit\s*[0-9a-f]{7,40}"
)
STATE_TRANSITION = (
    r"(?i)(?:通道|服务|Runner|端口).{0,20}(?:已恢复|恢复正常|首次中断|再次中断|再次离线)|"
    r"(?:已恢复|恢复正常).{0,20}(?:通道|服务|Runner|端口)"
)
SUPPORTING_OPENING = rf"^{WS}*系统指令："
SUPPORTING_SIGNATURE = "(?i)你是.{0,40}(?:Agent|智能体)|唯一工作重点|通过平台 Action"
COMPLETION_EVIDENCE = (
    r"(?i)(?:(?<![A-Za-z0-9_])[0-9a-f]{7,40}(?![A-Za-z0-9_])|测试.{0,12}通过|构建.{0,12}通过|验证.{0,12}通过|"
    r"(?<![A-Za-z0-9_])(?:build|test|check)(?![A-Za-z0-9_]).{0,24}(?:通过|成功)|HTTP\s*200|截图|commit|提交|安装位置|已写入)"
)
BLOCKED_LINE = (
    r"(?i)^(?:(?:本次|这次)(?:工作|任务)?|当前|任务)?\s*"
    r"(?:无法完成|未能完成|仍然受阻|需要用户|等待用户|缺少权限|blocked|无法继续)"
)
CONTINUING_LINE = (
    r"(?i)(?:并|，)\s*(?:将|会|需|需要)?继续(?:推进|处理|开发|完善|工作|优化|收口)?|后续(?:还要|将|会|需|需要)?继续"
)
COMPLETION_LINE = (
    r"(?i)^(?:(?:你[^。！？]{0,32}(?:所以|因此)[，,]?\s*)|(?:(?:本次|这次)(?:工作|任务)?)?\s*)(?:我\s*)?"
    r"(?:已完成|已经完成|已继续完成|已修复|已实现|已安装|已恢复|已提交|已全部处理|已定位并修复|已补上|已整理|"
    r"整理完成|修复完成|实现完成|安装完成|已经改成|已改成|已经改为|已改为|已经做完|已做完)"
)
BOUNDARY_LINE = (
    r"(?i)^(?:把下面.*发给|(?:以下|这是)?.*提示词|验收标准|请(?:你|将|按|完成|实现|开发|修复)|建议(?:你|先|改为|采用)?|"
    r"(?:这就清楚了[。！]?\s*)?你需要的(?:不是|是)|目标(?:是|：|:)|如果|可以(?:用|把|让)|下一步|后续(?:建议|计划)?|"
    r"模板(?:是|：|:))"
)
REPORT_BOUNDARY = r"(?i)(?:验收标准|提示词|下一步|后续(?:建议|计划)?|模板)\s*[：:]"
REPORT_COMMIT_LINE = r"(?i)(?:提交|commit)(?:为|是|：|:|\s)*[`']?[0-9a-f]{7,40}"
REPORT_SECTION_LABEL = r"(?i)^(?:验证|测试|限制|已知限制|来源|证据|下一步|后续)(?:结果)?\s*[：:]?$"
REPORT_LIMITATION = r"(?i)(?:尚未|未完成|仍需|限制|受限|失败|无法|不能|留待)"
REPORT_VALIDATION_SKIP = r"(?i)(?:测试|构建|验证|SHA256|HTTP|截图).*(?:通过|完成|成功|[0-9a-f]{7,})"
REPORT_VALIDATION = (
    r"(?i)(?:(?:测试|构建|验证|提交|commit|安装|SHA256|截图).*(?:通过|完成|成功|[0-9a-f]{7,})|HTTP\s*200)"
)
REPORT_COMMIT_HASH = r"(?i)(?:提交|commit)(?:为|是|：|:|\s)*[`']?([0-9a-f]{7,40})"

# --- fixed values: topic patterns ----------------------------------------------------------------
NEW_GOAL = (
    r"(?i)^(?:(?:新目标|新任务|另一个任务|另外一件事|切换任务|切换到|开始处理)\s*(?:是|为|要|请|做)?|"
    r"接下来\s*(?:请|要|做|我们)?)\s*[:：，,]?\s*(.+)$"
)
SHORT_CONTINUATION = r"^(?:好|好的|可以|确认|同意|do|继续|接着|执行|开始|修复)(?:\s+(?:do|继续|接着|执行|开始|修复))?$"
PROMPT_METADATA_LINE = (
    r"(?i)^(?:source_thread_id|项目目录|工作目录|仓库路径|路径|Files mentioned by the user|My request for Codex)\s*[:：]?"
)
RESTORED_TASK = r"(?i)恢复任务\s*([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
AGENT_TASK_FOLDER = r"(?i)(?:^|/)\.agent/tasks/([a-z0-9][a-z0-9._-]*)"
TOPIC_ISSUE = rf"(?i){WORD_EDGE}(?:issue|议题|问题单)\s*#?(\d{{1,8}}){WORD_EDGE}"
LINKED_ISSUE = r"(?i)(?:/issues/|(?<![A-Za-z0-9_])Issue\s*#?)(\d{1,8})(?![A-Za-z0-9_])"
WORK_ISSUE = r"(?i)(?:(?<![A-Za-z0-9_])issue\s*#?|/issues/)(\d{1,8})(?![A-Za-z0-9_])"
WORK_TASK = (
    rf"(?i)(?:{WORD_EDGE}(?:task|任务|工单)\s*(?:id)?\s*[:：#]?|/tasks/)([a-z0-9][a-z0-9._-]{{3,80}}){WORD_EDGE}"
)
FEEDBACK_ID = rf"(?i){WORD_EDGE}(?:feedback[_ -]?id|工单\s*ID|反馈\s*ID)\s*[:：#]?\s*([a-z0-9_-]{{4,64}})"
ISSUE_HEADLINE = r"(?i)(?<![A-Za-z0-9_])Issue\s*#?\d+[^「」]*「([^」]+)」"
AUTOMATION_KINDS = [
    (r"(?i)AI\s*HOT|每日早报|早报已送达", "AI 日报"),
    (r"(?i)工作日志|日志\s*ID|日志ID|记录\s*rec[a-z0-9]+", "飞书工作日报"),
    (r"(?i)反馈|工单|feedback:inbox", "平台反馈"),
]
AUTOMATION_SUGGESTION_KIND, AUTOMATION_DEFAULT_KIND, AUTOMATION_DEFAULT_NAME = "建议生成", "自动化", "例行自动化"
AUTOMATION_ID_TAG = r"(?i)<automation_id>([^<]+)</automation_id>"
INBOX_ITEM_TITLE = r'(?i)::inbox-item\{title="([^"]+)"'
PRIORITY_RULES = [
    (r"(?i)失败|报错|异常|根因|竞态|权限|受阻|恢复|重试|回滚", 5),
    (r"(?i)测试|验证|构建|提交|commit|SHA256|HTTP\s*200", 3),
    (r"(?i)方案|架构|设计|决策|取舍|边界|迁移", 2),
    (r"(?i)message_id|日志\s*ID|记录\s*rec[a-z0-9]+|(?:处理|回复|关闭).{0,16}(?:反馈|工单|Issue)", 4),
]
SYSTEM_REASONS = {
    "no-op-automation": "自动化本轮只有空队列、状态未变化或明确无新增的结果；原始记录保留，不重复生成知识。",
    "supporting-session": "该记录具有明确的内部辅助 Agent 指令签名，作为主任务证据保留，不独立生成 Wiki。",
}

# --- fixed values: artifact titles ---------------------------------------------------------------
CONVENTIONAL_ACTIONS = {
    "feat": "新增", "fix": "修复", "docs": "更新", "test": "补充", "style": "优化", "refactor": "重构",
    "perf": "优化", "revert": "撤销", "build": "更新", "ci": "更新", "chore": "更新",
}
CONVENTIONAL_PREFIX = r"(?i)^(?:fix|feat|docs|test|chore|refactor|style|perf)(?:\([^)]*\))?\s*[:：]\s*"
TITLE_STOP_WORDS = ["修复", "完成", "新增", "更新", "优化", "调整", "验证", "fix", "feat", "docs", "test", "chore"]
NATURAL_ACTION = (
    "^(?:新增|增加|实现|支持|完成|修复|解决|恢复|优化|改进|调整|更新|升级|完善|补充|重构|整理|记录|沉淀|发布|部署|安装|"
    "验证|测试|删除|移除|统一|保持|切换|新增功能|功能：|体验：|样式：|文档：|测试：)"
)
AREA_RULES = [
    ("every", r"(?i)(?:^|/)(?:docs?|requirements?|wiki)(?:/|$)|\.md$", "文档"),
    ("some", r"(?i)\.(?:css|scss|sass|less|html|vue|tsx|jsx)$", "界面"),
    ("some", r"(?i)(?:^|/)(?:tests?|__tests__)(?:/|$)|\.(?:test|spec)\.", "测试"),
    ("some", r"(?i)(?:package(?:-lock)?\.json|tsconfig|vite\.config|webpack|\.ya?ml)$", "工程配置"),
]
AREA_DEFAULT = "功能"
PROOF_LABELS = {"independent": "独立验证", "target-present": "目标存在", "report-only": "完成报告"}
KIND_LABELS = {
    "git-commit": "Git 提交", "knowledge-note": "知识笔记", "file-deliverable": "关联文件", "completion-report": "完成报告",
}
FILE_TITLE_CHARS, FILE_TITLE_SUFFIX, FILE_TITLE_FALLBACK = 96, "（完整标题见正文）", "未命名成果"

# --- fixed values: managed notes -----------------------------------------------------------------
#: Front-matter keys the generator owns, in their order.
MANAGED_KEYS = [
    "{prefix}_schema", "{prefix}_generated", "cssclasses", "aliases", "{prefix}_id", "{prefix}_fingerprint", "{prefix}_stale", "date", "project",
    "kind", "proof", "curation", "source_event_ids", "target_keys",
]
DAILY_KIND = "daily-artifact-index"
TARGET_KEYS = 6
LEGACY_ALIAS = "成果-"
AUTO_MARK = " · 自动整理"
REPORTED_MARK = "（Codex 报告）"
STALE_NOTICE = "> [!warning] 历史成果\n> 此文件已不在当前成果索引中。自动内容按历史记录保留。"
NOTE_HEADINGS = {
    "problem": "## 解决的问题", "result": "## 形成的成果", "validation": "## 验证结果", "targets": "## 实际入口", "sources": "## 来源证据",
    "limits": "## 已知限制", "user": "## 我的补充",
}
NOTE_FALLBACKS = {
    "problem": "未从来源中提取到明确问题描述。", "validation": "来源未提供明确验证结果。", "targets": "- 暂无可直接打开的实际入口。", "sources": "- 暂无来源。",
    "limits_independent": "未发现额外限制说明。", "limits": "该条目来自完成报告，仍需结合实际入口和来源证据判断。",
}
REPORT_SAID, REPORT_DELIVERED = "Codex 报告：", "Codex 交付说明："
NOTE_ERRORS = {
    "foreign": "目标文件不属于本库或结构已损坏，已拒绝覆盖", "invalid": "待写入成果文件结构无效", "other_id": "目标文件的 ID 不匹配，已拒绝覆盖",
    "no_alias": "目标文件不是可添加别名的成果",
}

# --- fixed values: secrets and personal data -----------------------------------------------------
REDACTIONS = [
    ("private_key",
     r"(?i)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
     "[已隐藏私钥]"),
    ("api_key", r"(?<![A-Za-z0-9_])(?:sk|rk|pk)-(?:proj-)?[A-Za-z0-9_-]{16,}(?![A-Za-z0-9_])(?<=[A-Za-z0-9_])", "[已隐藏密钥]"),
    ("vcs_token", r"(?<![A-Za-z0-9_])(?:ghp|github_pat|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{16,}(?![A-Za-z0-9_])",
     "[已隐藏 GitHub 凭据]"),
    ("cloud_key", r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])", "[已隐藏云凭据]"),
    ("jwt",
     r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_])(?<=[A-Za-z0-9_])",
     "[已隐藏令牌]"),
    ("key_value",
     r"(?i)(?<![A-Za-z0-9_])(authorization|api[_ -]?key|access[_ -]?token|password|passwd|secret)\s*[:=]\s*[\"']?[^\s,\"']{6,}",
     "$1=[已隐藏]"),
    ("database_url",
     r"(?i)(?<![A-Za-z0-9_])(postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s/@:]+:[^\s/@]+@",
     "$1://[已隐藏]@"),
]
# Lower-case literals of which a text must hold one for the rule to be able to match.
REDACTION_HINTS = {
    "private_key": ["-----begin"], "api_key": ["sk-", "rk-", "pk-"],
    "vcs_token": ["ghp_", "github_pat_", "gho_", "ghu_", "ghs_", "ghr_"], "cloud_key": ["akia"], "jwt": ["eyj"],
    "key_value": ["authorization", "api", "access", "passw", "secret"], "database_url": ["://"],
}
COLLAB_ID = r"(?<![A-Za-z0-9_])(?:ou|on|oc|cli|app|tenant)_[A-Za-z0-9_-]{6,}(?![A-Za-z0-9_])(?<=[A-Za-z0-9_])"
COLLAB_ID_MASK = "[飞书标识]"
SCAN_SECRETS = [
    ("vcs_token", r"(?<![A-Za-z0-9_])ghp_[A-Za-z0-9]{20,}(?![A-Za-z0-9_])"),
    ("vcs_pat", r"(?<![A-Za-z0-9_])github_pat_[A-Za-z0-9_]{20,}(?![A-Za-z0-9_])"),
    ("api_key", r"(?<![A-Za-z0-9_])sk-(?:proj-)?[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_])(?<=[A-Za-z0-9_])"),
    ("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("cloud_key", r"(?<![A-Za-z0-9_])AKIA[0-9A-Z]{16}(?![A-Za-z0-9_])"),
    ("receiver_token", r'"receiver_token"\s*:\s*"[A-Za-z0-9_-]{24,}"'),
    ("cli_id", r"(?<![A-Za-z0-9_])cli_[A-Za-z0-9]{16,}(?![A-Za-z0-9_])"),
    ("collab_id", r"(?<![A-Za-z0-9_])(?:ou|oc|bas|bascn|tbl|viw|rec)_[A-Za-z0-9]{16,}(?![A-Za-z0-9_])"),
    ("app_secret", r"(?i)(?<![A-Za-z0-9_])(?:app[_ -]?secret|tenant[_ -]?key)\s*[:=]\s*[\"']?[A-Za-z0-9_-]{12,}"),
]
SCAN_HINTS = {
    "vcs_token": ["ghp_"], "vcs_pat": ["github_pat_"], "api_key": ["sk-"], "private_key": ["-----begin"], "cloud_key": ["akia"],
    "receiver_token": ["receiver_token"], "cli_id": ["cli_"], "collab_id": ["ou_", "oc_", "bas_", "bascn_", "tbl_", "viw_", "rec_"],
    "app_secret": ["app", "tenant"], "email": ["@"], "ipv4": ["."],
}
EMAIL = r"(?i)(?<![A-Za-z0-9_])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![A-Za-z0-9_])"
EMAIL_RESERVED_SUFFIX = "@example.invalid"
IPV4 = r"(?<![A-Za-z0-9_])(?:\d{1,3}\.){3}\d{1,3}(?![A-Za-z0-9_])"
IPV4_LOOPBACK = "127.0.0.1"

# --- fixed values: collaboration records ---------------------------------------------------------
COLLAB_MODULES = ["tasks", "calendar", "meetings", "minutes", "documents", "base", "approvals", "messages"]
COLLAB_SCOPES = {
    "tasks": ["task:task:read"],
    "calendar": ["calendar:calendar.event:read"],
    "meetings": ["vc:meeting.search:read", "vc:recording:read"],
    "minutes": ["minutes:minutes.basic:read", "minutes:minutes.artifacts:read"],
    "documents": ["search:docs:read", "docs:document.content:read", "docx:document:readonly"],
    "base": ["search:docs:read", "base:table:read", "base:view:read", "base:record:read"],
    "approvals": ["approval:task:read", "approval:instance:read"],
    "messages": ["im:chat:read", "im:message:readonly"],
}
COLLAB_LABELS = {
    "tasks": "任务", "calendar": "日程", "meetings": "会议", "minutes": "会议纪要", "documents": "文档与 Wiki",
    "base": "Base", "approvals": "审批", "messages": "项目群消息",
}
COLLAB_DEFAULT_LABEL, COLLAB_RECORDED = "飞书", "已记录"
RESOURCE_ID_FIELDS = [
    "task_id", "event_id", "meeting_id", "minute_token", "document_id", "doc_token", "wiki_token", "record_id",
    "instance_code", "approval_code", "message_id", "id", "token",
]
RESOURCE_TITLE_FIELDS = [
    "title", "name", "summary", "task_name", "topic", "subject", "definition_name", "instance_name", "chat_name",
]
RESOURCE_UPDATED_FIELDS = ["update_time", "updated_at", "modified_time", "edit_time", "end_time", "create_time"]
RESOURCE_OCCURRED_FIELDS = ["start_time", "create_time", "created_at", "completed_at"]
RESOURCE_STATUS_FIELDS = ["status", "task_status", "approval_status", "state"]
RESOURCE_VERSION_FIELDS = ["version", "revision", "update_time", "updated_at", "modified_time", "edit_time"]
RESOURCE_PROJECT_FIELDS = ["project_name", "project", "chat_name"]
RESOURCE_LINK_FIELDS = ["url", "link", "web_url", "share_url", "app_link"]
RESOURCE_CONTENT_FIELDS = [
    "summary", "description", "content", "text", "result", "decision", "reason", "comment", "notes", "objective",
    "fields", "fetched_content", "approval_detail", "todo", "todos", "chapters", "keywords",
]
PAGE_LIST_FIELDS = ["items", "records", "tasks", "events", "meetings", "minutes", "documents", "messages", "list"]
PAGE_TOKEN_FIELDS = ["page_token", "next_page_token", "nextPageToken", "next_cursor"]
PAGE_MORE_FIELDS = ["has_more", "hasMore"]
HIDDEN_KEYS = r"(?i)(?:token|secret|password|authorization|open_id|user_id|tenant)"
MINUTE_TOKEN_KEY, MINUTE_TOKEN_VALUE = r"(?i)minute.?token", r"^[A-Za-z0-9._-]{4,256}$"
KIND_TASK_DONE = "(?i)完成|done|completed|closed"
KIND_TASK_BLOCKED = "(?i)阻塞|blocked|暂停"
ACTIVITY_TASK_BLOCKED = "(?i)阻塞|blocked|卡住|暂停"
ACTIVITY_BASE_DONE = "(?i)完成|closed|done"
ACTIVITY_BASE_BLOCKED = "(?i)阻塞|blocked"
ACTIVITY_OUTPUT = "决定|结论|交付|完成"
MESSAGE_SUBSTANTIVE = (
    "(?i)(?:决定|结论|确认|通过|拒绝|完成|交付|发布|上线|修复|问题|原因|方案|解决|待办|负责人|截止|阻塞|风险|验收|反馈|"
    "需求|任务|链接|文档|提交|commit|issue|todo|blocked)"
)
MESSAGE_CHATTER = r"(?i)^(?:好的?|收到|明白|谢谢|辛苦了|ok|okay|嗯+|哈+|赞|1|已阅)[。.!！~～\s]*$"
MESSAGE_BROADCAST = "(?:系统通知|机器人通知|自动播报|例行提醒|打卡提醒|会议即将开始)"
ERROR_RATE_LIMIT = r"(?i)rate.?limit|429|1254290"
ERROR_AUTH = r"(?i)expired|invalid.?token|unauthorized"
ERROR_PERMISSION = "(?i)permission|forbidden|91403|2091005"
ERROR_ACCESS = {"auth_expired": "authorization_expired", "missing_scope": "missing_scope", "permission": "revoked"}
ERROR_ACCESS_DEFAULT = "temporarily_unavailable"
CHAT_HOSTS = ["chatgpt.com", "chat.openai.com"]
CONVERSATION_ID = r"^[A-Za-z0-9._-]{6,160}$"
ABORTED_TEXT = "本轮任务已中止"

# --- fixed values: notes -------------------------------------------------------------------------
SOURCE_MARKER = r"<!--\s*(?:codex-source|chatgpt-qna|codex-qna)\s*:\s*prompt=([^;\s]+);stop=([^\s]+)\s*-->"
DAILY_LINK = r"\((?:\.\./)*raw/(?:codex|chatgpt)/daily/(\d{4}-\d{2}-\d{2})\.md\)"
EVIDENCE_HEADINGS = [
    "问题与现象", "根因与判断依据", "尝试过的路径", "可复用的解决路径", "适用条件与边界", "验证方式与结果", "下次快速识别",
    "来源与关联",
]
MEMORY_HEADINGS = [
    "当时我想做什么", "我遇到了什么", "我是怎么判断的", "我最后做了什么", "这次留下了什么", "下次遇到时", "需要追溯时",
]
MEMORY_TRACE_HEADING = "需要追溯时"
DIGEST_LABELS = {"about": "这是什么", "problem": "解决了什么", "result": "得到什么", "next_use": "以后怎么用"}
DIGEST_OVERVIEW = "一眼看懂"
DIGEST_LEGACY = ("问题与现象", "验证方式与结果", "可复用的解决路径")
DIGEST_LEGACY_PREFIX = "这是旧版知识记录，原文从这个问题开始："
CONCLUSION_HEADING = "结论"
JARGON = "闭环|收口|纵切片|权威状态|漂移重校验|自证授权|技术边界"
VAGUE_DIGEST = [
    "^(?:这|该)?(?:是|次)?(?:一个|一项)?(?:值得)?(?:沉淀|整理|总结|记录)?(?:的)?(?:问题|经验|内容|方案|闭环|结果)[。.]?$",
    "^(?:已|已经)?(?:完成|形成)(?:了)?(?:闭环|验证|方案|处理|整理|总结)[。.]?$",
]
NARRATOR_DIGEST = "^这篇(?:整理|记录|文章)"
CAMEL_WORD = r"(?<![A-Za-z0-9_])[A-Za-z]+[a-z][A-Z][A-Za-z]*(?![A-Za-z0-9_])"
TRUST_LEVELS = ["verified", "observed", "inferred"]

# --- fixed values: fallback words ----------------------------------------------------------------
UNTITLED_ACTIVITY, UNASSIGNED, KNOWLEDGE_BASE, GENERAL = "未命名活动", "未归属", "知识库", "通用"
EXPERIENCE_FOLDER = "我的经历"
SYSTEM_PATHS = [r"(?i)\\Program Files\\WindowsApps\\OpenAI\.Codex_", r"(?i)\\Program Files\\Obsidian"]
METRIC_LABELS = {"activity": "任务推进", "output": "产出", "knowledge": "知识", "reuse": "积累", "focus": "项目切换"}
