"""Word lists, lookup tables and patterns whose content decides results."""

DEFAULT_TYPE = "其他治疗"

ENTITY_TYPES = ("疾病", "症状", "西药", "中成药", "中草药", "药物", "病原体", "检查", "诊疗技术及设备", "手术治疗", "其他治疗", "部位", "科室", "指南建议", "流行病学")

STRUCTURED_TYPES = {
    "疾病": "疾病", "症状": "症状", "西药": "西药", "中成药": "中成药", "中草药": "中草药", "药物": "药物", "检查": "检查",
    "诊疗技术及设备（治疗）": "诊疗技术及设备", "手术治疗": "手术治疗", "其他治疗": "其他治疗", "其他": "其他治疗", "部位": "部位",
    "科室": "科室", "社会学": "流行病学", "预后": "流行病学", "流行病学": "流行病学", "病原体": "病原体", "指南建议": "指南建议",
}

GUIDELINE_TYPES = {
    '"指南建议"': "指南建议", '"检查"': "检查", '"疾病"': "疾病", '"流行病学"': "流行病学", '"其他治疗"': "其他治疗", '"预后"': "流行病学",
    '"西药"': "西药", '"病原体"': "病原体", '"症状"': "症状", '"科室"': "科室", '"诊疗技术及设备（治疗）"': "诊疗技术及设备", '"部位"': "部位",
    '"药物"': "药物", '"手术治疗"': "手术治疗", '"中草药"': "中草药", '"中成药"': "中成药", "UNKNOWN": "其他治疗", '"概念"': "其他治疗",
    '"其他"': "其他治疗", '"治疗"': "其他治疗", '"组织"': "科室", "PERSON": "流行病学", '"治疗方案"': "其他治疗", '"高危因素"': "流行病学",
    "RELATIONSHIP": "其他治疗", "LOCATION": "部位", '"药代动力学"': "西药", '"机构"': "科室", '"机制"': "流行病学",
}

RELATIONS = {
    "不良反应": "不良反应", "症状": "临床表现", "临床症状及体征": "临床表现", "相关症状": "临床表现", "适应症": "适应症", "成份": "成份",
    "药物相互作用": "药物相互作用", "同义词": "同义词", "治疗": "治疗", "治疗方式": "治疗", "药物治疗": "治疗", "分类": "分类", "一级分类": "分类",
    "二级分类": "分类", "英文名称": "英文名称", "注意事项": "注意事项", "并发症": "并发症", "检查": "检查", "辅助检查": "检查", "诊断依据": "诊断依据",
    "相关疾病": "相关疾病", "所属科室": "所属科室", "就诊科室": "所属科室", "用法用量": "用法用量", "病因": "病因", "禁忌": "禁忌", "禁忌症": "禁忌",
    "药品分类": "药品分类", "药品监管分级": "药品监管分级", "商品名": "商品名", "易感人群": "易感人群", "多发群体": "易感人群", "发病部位": "发病部位",
    "贮藏": "贮藏", "高危因素": "高危因素", "预防": "预防", "预后": "预后", "传播途径": "传播途径", "所属分类": "分类", "发病率": "流行病学",
    "患病率": "流行病学",
}

#: The tail's type by relation; None: that of the head.
TAIL_TYPES = {
    "不良反应": "症状", "临床表现": "症状", "适应症": "疾病", "成份": "药物", "治疗": "药物", "并发症": "疾病", "相关疾病": "疾病", "病因": "病原体",
    "检查": "检查", "所属科室": "科室", "发病部位": "部位", "高危因素": "流行病学", "预防": "其他治疗", "预后": "流行病学", "药物相互作用": "西药",
    "英文名称": "药物", "商品名": "西药", "禁忌": "疾病", "易感人群": "流行病学", "诊断依据": "检查", "注意事项": "其他治疗", "用法用量": "其他治疗",
    "分类": "其他治疗", "药品分类": "其他治疗", "药品监管分级": "其他治疗", "贮藏": "其他治疗", "传播途径": "流行病学", "流行病学": "流行病学",
    "同义词": None,
}

DIAGNOSIS_LABELS = ("最终答案", "肺部相关疾病诊断", "肺部相关诊断", "诊断")
TRUTH_LABELS = ("最终答案", "肺部相关诊断", "诊断")
DIAGNOSIS_SKIP_STARTS = ("请", "建议", "注意", "以上", "综上", "目前", "考虑", "当前", "该病", "该患", "总", "综", "因此", "所以", "依据", "首先", "其次", "然后", "最后", "另外", "此外", "最终答案", "肺部相关", "诊断")
DIAGNOSIS_SKIP_PARTS = ("以下几种", "包括但不限于", "考虑为", "不排除", "需排除", "需进一步", "建议进一步", "必要时", "应进一步", "综上所述", "结合以上", "综合以上")
DIAGNOSIS_EXAMPLES = ("如", "比如", "例如", "如为")

RELATION_INDICATORS = (
    "引起", "导致", "表现", "症状", "检查", "诊断", "治疗", "并发症", "提示", "显示", "支持", "排除", "常见于", "多见于", "提示为", "考虑", "怀疑",
    "属于", "包括", "分为", "表现为", "出现", "使用", "给予", "予以", "服用", "注射", "发现", "检出", "检测", "测定", "符合", "依据",
)

#: Sections whose removal the cleaning audit looks for: English and Chinese keyword.
AUDIT_SECTIONS = (("References", "参考文献"), ("Conflict", "利益冲突"), ("Funding", "资金"), ("Acknowledgment", "致谢"), ("Author", "作者"))

SEPARATORS = ("\n\n", "\r\n\r\n", "\n", "\r\n", "。", "．", ".", "！", "!", "？", "?", " ", "\t", "　", "​")

FIELD_SEP, TUPLE_DELIMITER, RECORD_DELIMITER, COMPLETION = "<SEP>", "<|>", "##", "<|COMPLETE|>"
NO_TYPE = "UNKNOWN"

# The patterns by which diagnoses, answers and scanned lines are told.
DIAGNOSIS_WRAPPING = "*_-#。，, []"
DIAGNOSIS_REMARK = r"[（(][^)）]*[)）]?$"
DIAGNOSIS_OPEN_BRACKET = "[）)]$|^[（(]"
DIAGNOSIS_SEPARATOR = "[,，、;；]"
BOLD = r"\*{1,3}([^*]+?)\*{1,3}"
ITALIC = r"_{1,2}([^_]+?)_{1,2}"
BRACKETED = r"\[([^\]]+)\]"
AFTER_LABEL = r"[：:]\s*([^\n]+)"
LAST_AFTER_LABEL = r"[：:]\s*(.+)$"
STRUCTURED_LINES = (r"^[-•·●▪*]", r"^\d{1,3}[.、)）]", r"^\([0-9a-zA-Z]+\)", r"^(?:#|Table|表)")
SHORT_LINE = 20
SENTENCE_END = r"[。．.!?！？:：；;]$"
