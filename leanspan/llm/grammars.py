"""Grammars, in the notation of :mod:`gll`, for the parsed languages.

They derive every token sequence of the language that its published grammar
derives, up to rules that need names or types; operator precedence is left out,
because acceptance does not depend on it.  Where a language has dialects the
alternatives stand side by side in one grammar and are followed together.
"""

PYTHON = r"""
file = NL* stmts? NL* ;
stmts = (statement)+ ;
suite = stmts ;
!statement = simple_line | compound ;
simple_line = simple (';' simple)* ';'? NL ;
block = simple_line | NL @<suite> ;
simple = assignment | 'pass' | 'break' | 'continue' | 'return' star_exprs? | 'raise' (expr ('from' expr)?)?
  | 'global' ident (',' ident)* | 'nonlocal' ident (',' ident)* | 'del' del_targets
  | 'assert' expr (',' expr)? | imports | 'type' ident type_params? '=' expr ;
assignment = (star_targets '=')* rhs | one_target ( augassign rhs | ':' expr ('=' rhs)? ) ;
rhs = star_exprs | yield_expr ;
augassign = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
imports = 'import' dotted ('as' ident)? (',' dotted ('as' ident)?)*
  | 'from' ( ('.' | '...')+ dotted? | dotted ) 'import' ( '*' | import_names | @(import_group) ) ;
dotted = ident ('.' ident)* ;
import_names = ident ('as' ident)? (',' ident ('as' ident)?)* ;
import_group = import_names ','? ;
compound = ('@' named NL)* ( funcdef | classdef ) | if_stmt
  | 'async'? 'for' star_targets 'in' star_exprs ':' block ('else' ':' block)?
  | 'while' named ':' block ('else' ':' block)?
  | 'try' ':' block ( ('except' '*'? (expr (',' expr)* ('as' ident)?)? ':' block)+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block )
  | 'async'? 'with' ( with_items | @(with_group) ) ':' block
  | 'match' star_exprs ':' NL @<cases> ;
if_stmt = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? ;
with_items = expr ('as' target)? (',' expr ('as' target)?)* ;
with_group = with_items ','? ;
cases = ( 'case' patterns ('if' named)? ':' block )+ ;
patterns = pattern (',' pattern)* ','? ;
pattern = '*' ident | pattern_or ('as' ident)? ;
pattern_or = pattern_atom ('|' pattern_atom)* ;
pattern_atom = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted @(pattern_args)? | @(pattern_group) | @[pattern_group] | @{pattern_map} ;
pattern_args = (pattern_arg (',' pattern_arg)* ','?)? ;
pattern_arg = (ident '=')? pattern ;
pattern_group = patterns? ;
pattern_map = (pattern_item (',' pattern_item)* ','?)? ;
!pattern_item = pattern_atom ':' pattern | '**' ident ;
funcdef = 'async'? 'def' ident type_params? @(params) ('->' exprs)? ':' block ;
classdef = 'class' ident type_params? @(args)? ':' block ;
type_params = @[type_param_list] ;
type_param_list = ('*' | '**')? ident (':' expr)? ('=' expr)? (',' ('*' | '**')? ident (':' expr)? ('=' expr)?)* ','? ;
params = ( by_place (',' by_name)? ','? | by_name ','? )? ;
by_place = plain (',' plain)* ( ',' '/' (',' plain)* )? (',' preset)* | plain (',' plain)* (',' preset)+ ',' '/' (',' preset)* | preset (',' preset)* ( ',' '/' (',' preset)* )? ;
by_name = '*' ident (':' star_expr)? (',' (plain | preset))* (',' '**' plain)? | '*' (',' (plain | preset))+ (',' '**' plain)? | '**' plain ;
plain = ident (':' expr)? ;
preset = ident (':' expr)? '=' expr ;
lambda_params = ( l_by_place (',' l_by_name)? ','? | l_by_name ','? )? ;
l_by_place = ident (',' ident)* ( ',' '/' (',' ident)* )? (',' l_preset)* | ident (',' ident)* (',' l_preset)+ ',' '/' (',' l_preset)* | l_preset (',' l_preset)* ( ',' '/' (',' l_preset)* )? ;
l_by_name = '*' ident (',' (ident | l_preset))* (',' '**' ident)? | '*' (',' (ident | l_preset))+ (',' '**' ident)? | '**' ident ;
l_preset = ident '=' expr ;
star_targets = star_target (',' star_target)* ','? ;
star_target = '*'? target ;
target = ident | @(targets) | @[targets] | place ;
targets = star_targets? ;
place = atom ( '.' ident | @(args) | @[subscripts] )* ( '.' ident | @[subscripts] ) ;
one_target = ident | place | @(one_group) ;
one_group = one_target ;
del_targets = target (',' target)* ','? ;
exprs = expr (',' expr)* ','? ;
star_exprs = star_expr (',' star_expr)* ','? ;
star_expr = '*'? expr ;
yield_expr = 'yield' ('from' expr | star_exprs)? ;
named = (ident ':=')? expr ;
expr = 'lambda' lambda_params ':' expr | disjunction ('if' disjunction 'else' expr)? ;
disjunction = operand (binop operand)* ;
binop = '+' | '-' | '*' | '/' | '//' | '%' | '**' | '@' | '&' | '|' | '^' | '<<' | '>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' 'not'? | 'and' | 'or' ;
operand = ('not' | '-' | '+' | '~')* 'await'? primary ;
primary = atom ( '.' ident | @(args) | @[subscripts] )* ;
atom = ident | NUM | STR+ | '...' | 'None' | 'True' | 'False' | @(paren) | @[list] | @{braces} ;
ident = NAME | 'match' | 'case' | 'type' ;
paren = (star_named (',' star_named)* ','?)? | named comp_for | yield_expr ;
list = (star_named (',' star_named)* ','?)? | named comp_for ;
!star_named = '*' operand (binop operand)* | named ;
braces = (dict_item (',' dict_item)* ','?)? | expr ':' expr comp_for | star_named (',' star_named)* ','? | named comp_for ;
!dict_item = '**' disjunction | expr ':' expr ;
comp_for = ('async'? 'for' star_targets 'in' disjunction ('if' disjunction_named)*)+ ;
disjunction_named = (ident ':=')? expr_nocond ;
expr_nocond = disjunction | 'lambda' lambda_params ':' expr ;
args = ( positional (',' positional)* (',' keywords)? ','? | keywords ','? )? | named comp_for ;
positional = '*' expr | named ;
keywords = ident '=' expr (',' ( ident '=' expr | '*' expr ))* (',' '**' expr (',' ( ident '=' expr | '**' expr ))* )? | '**' expr (',' ( ident '=' expr | '**' expr ))* ;
subscripts = subscript (',' subscript)* ','? ;
subscript = '*'? named | expr? ':' expr? (':' expr?)? ;
"""

# One grammar for ECMAScript modules and its typed dialect; JS_ONLY and TS_ONLY close it.
SCRIPT = r"""
file = HASHBANG? block_items ;
block_items = ( statement | NL | ';' )* ;
end = ';' | NL ;
nls = NL* ;
!statement = @{block_items} | variable end | function | class_decl | 'import' import_rest end | 'export' export_rest
  | 'if' @(test) nls statement (nls 'else' nls statement)? | 'for' 'await'? @(for_head) nls statement
  | 'while' @(test) nls statement | 'do' nls statement nls 'while' @(test) end?
  | 'try' @{block_items} nls ('catch' @(catch_param)? @{block_items} nls)? ('finally' @{block_items})?
  | 'switch' @(test) @{switch_body} | 'return' expr? end | 'throw' expr end | ('break' | 'continue') ident? end
  | 'debugger' end | ident ':' nls statement | expr end | typed_statement ;
variable = ('var' | 'let' | 'const' | 'using') binding (',' binding)* ;
binding = target '!'? annotation? ('=' assign)? ;
target = ident | @{object_pattern} | @[array_pattern] ;
object_pattern = NL* (prop_pattern NL* (',' NL* prop_pattern NL*)* ','? NL*)? ;
prop_pattern = '...' target | prop_name ':' target ('=' assign)? | ident ('=' assign)? ;
array_pattern = ','* (elem_pattern (','+ elem_pattern)* ','*)? ;
elem_pattern = '...'? target ('=' assign)? ;
test = expr ;
for_head = ((variable | expr)? ';' expr? ';' expr?) | (('var' | 'let' | 'const' | 'using' | 'await' 'using')? target | operand) ('of' | 'in') expr ;
catch_param = target annotation? ;
switch_body = NL* ( ('case' expr | 'default') ':' (statement | NL | ';')* )* ;
import_rest = STR import_with? | 'type'? 'defer'? import_clause 'from' STR import_with? | @(args) tail* (op_rest)* | '.' name tail* (op_rest)* | typed_import ;
import_with = ('with' | 'assert') @{object} ;
import_clause = ident (',' (@{specifiers} | '*' 'as' ident))? | @{specifiers} | '*' 'as' ident ;
specifiers = NL* (specifier NL* (',' NL* specifier NL*)* ','? NL*)? ;
specifier = 'type'? (name | STR) ('as' (name | STR))? ;
export_rest = '*' ('as' (name | STR))? 'from' STR import_with? end | 'type'? @{specifiers} ('from' STR import_with?)? end
  | 'default' ( function | class_decl | assign end | typed_default ) | variable end | function | class_decl | typed_export | decorators NL* class_decl ;
function = 'async'? 'function' '*'? ident? type_params? @(params) return_type? ( @{block_items} | overload ) ;
params = (param (',' param)* ','?)? ;
param = decorators? modifier* '...'? ( target | 'this' ) '?'? annotation? ('=' assign)? ;
class_decl = (decorators NL*)? 'abstract'? 'class' ident? type_params? ('extends' operand)? implements? @{class_body} ;
class_body = ( member | NL | ';' )* ;
!member = (decorators NL*)? modifier* ( 'static' @{block_items} | ('get' | 'set')? 'async'? '*'? (prop_name | PRIVATE) ('?' | '!')? type_params? @(params) return_type? ( @{block_items} | overload )
  | 'accessor'? (prop_name | PRIVATE) ('?' | '!')? annotation? ('=' assign)? end | index_member end ) ;
modifier = 'static' | modifier_typed ;
decorators = ('@' ( ident ('.' name)* @(args)? | @(test) ) NL*)+ ;
prop_name = name | STR | NUM | @[test] ;
name = ident | 'this' | 'super' | %KW ;
expr = assign (',' later)* ;
!later = assign ;
assign = place assign_op assign | chain | arrow | 'yield' '*'? assign? ;
place = typed_cast? ( ident | @(test) | @[array] | @{object} | primary tail* ( '.' (name | PRIVATE) | @[test] | typed_place ) ) ;
assign_op = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' | '>' '>' '>'? '=' ;
arrow = 'async'? ( ident | type_params? @(params) return_type? ) '=>' ( assign | @{block_items} ) ;
chain = operand op_rest* ;
op_rest = binop operand | '?' assign ':' assign | typed_op ;
binop = '+' | '-' | '*' | '/' | '%' | '**'
  | '&' | '|' | '^' | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '<<' | '>' '='? | '>' '>' '>'? | 'in' | 'instanceof' ;
operand = ( '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' )* prefixed ;
prefixed = (typed_cast)? ( PRIVATE | primary tail* ('++' | '--')? ) ;
tail = '.' (name | PRIVATE) | '?.' ( name | PRIVATE | @(args) | @[test] | TPL ) | @(args) | @[test] | TPL | typed_tail ;
primary = ident | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | TPL | REGEX | @(test) | @[array] | @{object} | function | class_decl
  | 'new' ( '.' name | operand ) | 'import' ( @(args) | '.' name ) ;
args = (('...'? assign) (',' '...'? assign)* ','?)? ;
array = ','* (array_item (','+ array_item)* ','*)? ;
!array_item = '...'? assign ;
object = NL* (property NL* (',' NL* property NL*)* ','? NL*)? ;
!property = '...' assign | ident ('=' assign)? | prop_name ':' assign | ('get' | 'set')? 'async'? '*'? prop_name type_params? @(params) return_type? @{block_items} ;
ident = NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'as' | 'from' | 'type' | 'let' | 'using' | 'defer' | 'accessor' | 'with' | 'assert' | 'yield' | 'await' | 'abstract' | typed_ident ;
"""
JS_ONLY = r"""
typed_statement = NEVER ; typed_import = NEVER ; typed_default = NEVER ; typed_export = NEVER ; overload = NEVER ; implements = NEVER ;
index_member = NEVER ; modifier_typed = NEVER ; typed_op = NEVER ; typed_cast = NEVER ; typed_tail = NEVER ; typed_place = NEVER ; annotation = NEVER ; return_type = NEVER ; type_params = NEVER ;
typed_ident = 'declare' | 'namespace' | 'module' | 'interface' | 'readonly' | 'public' | 'private' | 'protected' | 'override' | 'keyof' | 'infer' | 'is' | 'asserts' | 'unique' | 'satisfies' | 'out' | 'implements' ;
"""
TS_ONLY = r"""
typed_statement = declaration | 'declare' ( declaration | variable end | function | class_decl | 'global' @{block_items} | 'module' STR (@{block_items} | end) ) | 'abstract' class_decl ;
declaration = 'interface' ident type_params? ('extends' type (',' type)*)? @{type_members} | 'type' ident type_params? '=' nls type end
  | 'const'? 'enum' ident @{enum_body} | ('namespace' | 'module') ident ('.' ident)* @{block_items} ;
typed_import = 'type'? ident '=' ( 'require' @(args) | ident ('.' name)* ) ;
typed_default = 'interface' ident type_params? ('extends' type (',' type)*)? @{type_members} | 'abstract' class_decl ;
typed_export = declaration | 'declare' ( declaration | variable end | function | class_decl ) | '=' expr end | 'as' 'namespace' ident end | 'import' ident '=' expr end ;
overload = end ;
implements = 'implements' type (',' type)* ;
index_member = @[index_signature] annotation ;
modifier_typed = 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'in' | 'out' ;
typed_op = ('as' | 'satisfies') type | 'as' 'const' ;
typed_cast = '<' type '>' ;
typed_tail = '!' | type_args ;
typed_place = '!' ;
annotation = ':' type ;
return_type = ':' type ;
type_params = '<' type_param (',' type_param)* ','? '>' ;
type_param = ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)? ;
type_args = '<' type (',' type)* ','? '>' ;
type = 'asserts'? (ident | 'this') 'is' type | 'asserts' (ident | 'this') | union ('extends' union '?' type ':' type)? | 'abstract'? 'new' type_params? @(params) '=>' type | type_params? @(params) '=>' type ;
union = '|'? intersection ('|' intersection)* ;
intersection = '&'? type_operand ('&' type_operand)* ;
type_operand = ('keyof' | 'readonly' | 'unique')* type_primary ( @[array] | @[index_type] )* | 'infer' ident ('extends' type_operand)? ;
type_primary = 'typeof' (ident | 'this' | 'import' @(args)) ('.' (name | PRIVATE))* type_args? | type_name type_args? | 'void' | 'null' | 'this' | 'true' | 'false' | '-'? NUM | STR | TPL | TYPE_TPL
  | @(type_group) | @[tuple] | @{type_members} | @{mapped} | 'import' @(args) ('.' name)* type_args? ;
type_name = ident ('.' name)* ;
type_group = type ;
index_type = type ;
tuple = (tuple_item (',' tuple_item)* ','?)? ;
!tuple_item = '...'? (name '?'? ':')? type '?'? ;
type_members = ( type_member? (';' | ',' | NL) )* type_member? ;
type_member = ('readonly' | '+' 'readonly' | '-' 'readonly')* ( ('get' | 'set')? prop_name '?'? ( annotation? | type_params? @(params) return_type? ) | type_params? @(params) return_type? | 'new' type_params? @(params) return_type? | @[index_signature] annotation? ) ;
index_signature = ident ':' type ;
mapped = NL* ('+' | '-')? 'readonly'? @[mapped_key] (('+' | '-')? '?')? annotation? (';' | ',' | NL)* ;
mapped_key = ident 'in' type ('as' type)? ;
enum_body = NL* (enum_item NL* (',' NL* enum_item NL*)* ','? NL*)? ;
enum_item = (name | STR) ('=' assign)? ;
typed_ident = 'declare' | 'namespace' | 'module' | 'interface' | 'readonly' | 'public' | 'private' | 'protected' | 'override' | 'keyof' | 'infer' | 'is' | 'asserts' | 'unique' | 'satisfies' | 'out' | 'implements' | 'require' | 'global' ;
"""

GO = r"""
file = 'package' NAME ';' (imports ';')* (top ';')* ;
imports = 'import' ( import_spec | @(import_specs) ) ;
import_spec = ('.' | NAME)? STR ;
import_specs = (import_spec (';' import_spec)*)? ';'? ;
!top = function | decl ;
decl = 'const' ( const_spec | @(const_specs) ) | 'var' ( var_spec | @(var_specs) ) | 'type' ( type_spec | @(type_specs) ) ;
const_spec = names (type? '=' exprs)? ;
const_specs = (const_spec (';' const_spec)*)? ';'? ;
var_spec = names ( type ('=' exprs)? | '=' exprs ) ;
var_specs = (var_spec (';' var_spec)*)? ';'? ;
type_spec = NAME @[type_params]? '='? type ;
type_specs = (type_spec (';' type_spec)*)? ';'? ;
type_params = type_param (',' type_param)* ','? ;
type_param = names constraint ;
constraint = '~'? type ('|' '~'? type)* ;
names = NAME (',' NAME)* ;
function = 'func' @(params)? NAME @[type_params]? signature @{block}? ;
signature = @(params) ( type | @(params) )? ;
params = (param (',' param)* ','?)? ;
param = names? '...'? type | NAME ;
type = NAME ('.' NAME)? @[type_list]? | '*' type | @[array_len] type | @[nothing] type | 'map' @[type_one] type | 'chan' '<-'? type | '<-' 'chan' type
  | 'struct' @{fields} | 'interface' @{methods} | 'func' signature | @(type_one) ;
type_one = type ;
type_list = type (',' type)* ','? ;
array_len = expr | '...' ;
nothing = ;
fields = (field (';' field)*)? ';'? ;
field = ( names type | '*'? NAME ('.' NAME)? @[type_list]? ) STR? ;
methods = (method (';' method)*)? ';'? ;
method = NAME signature | constraint ;
block = (statement? ';')* statement? ;
!statement = decl | NAME ':' statement? | simple | 'return' exprs? | ('break' | 'continue' | 'goto') NAME? | 'fallthrough' | 'go' expr | 'defer' expr
  | @{block} | if_stmt | 'switch' switch_head @{cases} | 'select' @{comms} | 'for' for_head @{block} ;
simple = names ':=' exprs | expr ('++' | '--') | exprs ( ('=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=') exprs )? | expr '<-' expr ;
if_stmt = 'if' (simple? ';')? expr @{block} ('else' (if_stmt | @{block}))? ;
switch_head = (simple? ';')? ( simple )? ;
cases = ( ('case' case_list | 'default') ':' (statement? ';')* statement? )* ;
case_list = (expr | type) (',' (expr | type))* ;
comms = ( ('case' simple | 'default') ':' (statement? ';')* statement? )* ;
for_head = ( simple? ';' expr? ';' simple? | expr | (exprs '=' | names ':=')? 'range' expr )? ;
exprs = expr (',' expr)* ;
expr = operand (binop operand)* ;
binop = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
operand = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* primary ( '.' NAME | '.' @(assertion) | @(args) | @[index] | @{composite} )* ;
assertion = type | 'type' ;
primary = NAME | NUM | STR | @(paren) | 'func' signature @{block}? | literal_type @{composite}? | literal_type @(args) ;
paren = expr | type ;
literal_type = 'struct' @{fields} | @[array_len] type | @[nothing] type | 'map' @[type_one] type | 'chan' type | 'interface' @{methods} ;
args = ((expr | type) '...'? (',' (expr | type) '...'?)* ','?)? ;
index = expr | type_list | expr? ':' expr? (':' expr)? ;
composite = (element (',' element)* ','?)? ;
!element = ( (expr | @{composite}) ':' )? (expr | @{composite}) ;
"""

JAVA = r"""
file = (annotations? 'package' qualified ';')? (imports | ';')* (type_decl | ';')* | method_file | module_decl ;
module_decl = (imports)* annotations? 'open'? 'module' qualified @{any} ;
method_file = (imports)* (member)+ ;
imports = 'import' 'static'? qualified ('.' '*')? ';' ;
qualified = ident ('.' ident)* ;
annotations = annotation+ ;
annotation = '@' qualified @(annotation_args)? ;
annotation_args = (annotation_arg (',' annotation_arg)* ','?)? ;
annotation_arg = (ident '=')? annotation_value ;
annotation_value = chain | annotation | @{annotation_array} ;
annotation_array = (annotation_value (',' annotation_value)*)? ','? ;
modifiers = ( annotation | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed' )* ;
!type_decl = modifiers ( 'class' ident type_params? ('extends' type)? ('implements' types)? ('permits' types)? @{class_body}
  | 'interface' ident type_params? ('extends' types)? ('permits' types)? @{class_body} | 'enum' ident ('implements' types)? @{enum_body}
  | 'record' ident type_params? @(params) ('implements' types)? @{class_body} | '@' 'interface' ident @{class_body} ) ;
type_params = '<' type_param (',' type_param)* '>' ;
type_param = annotation* ident ('extends' type ('&' type)*)? ;
types = type (',' type)* ;
type = annotation* ( primitive | class_type ) dims ;
dims = (annotation* @[nothing])* ;
nothing = ;
primitive = 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double' | 'void' ;
class_type = ident type_args? ('.' annotation* ident type_args?)* ;
type_args = '<' (type_arg (',' type_arg)*)? '>' ;
type_arg = annotation* ( '?' (('extends' | 'super') type)? | type ) ;
class_body = (member | ';')* ;
!member = type_decl | 'static'? @{block} | modifiers type_params? ( type ident @(params) dims throws? ( @{block} | ('default' annotation_value)? ';' ) | ident @(params) throws? @{block} | ident @{block} | type declarators ';' ) ;
throws = 'throws' types ;
declarators = declarator (',' declarator)* ;
declarator = ident dims ('=' (expr | @{array_init}))? ;
array_init = (array_item (',' array_item)*)? ','? ;
!array_item = expr | @{array_init} ;
enum_body = (enum_item (',' enum_item)*)? ','? (';' (member | ';')*)? ;
enum_item = annotation* ident @(args)? @{class_body}? ;
params = (param (',' param)*)? ;
param = ( annotation | 'final' )* type annotation* '...'? ( ident ('.' 'this')? | 'this' ) dims ;
block = (statement)* ;
!statement = ';' | @{block} | type_decl | ( annotation | 'final' )* ( type | 'var' ) declarators ';' | 'if' @(test) statement ('else' statement)? | 'while' @(test) statement
  | 'do' statement 'while' @(test) ';' | 'for' @(for_head) statement | 'try' @(resources)? @{block} ('catch' @(catch_param) @{block})* ('finally' @{block})?
  | 'switch' @(test) @{switch_body} | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') ident? ';' | 'yield' expr ';' | 'synchronized' @(test) @{block}
  | 'assert' expr (':' expr)? ';' | ident ':' statement | statement_expr ';' ;
statement_expr = place assign_op expr | ('++' | '--') primary tail* | primary tail* ( '++' | '--' | @(args) | '.' type_args? 'new' creator ) | 'new' creator ;
place = ident | @(test) | primary tail* ( '.' ident | @[test] ) ;
assign_op = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '>'? '=' ;
test = expr ;
for_head = ( ( annotation | 'final' )* (type | 'var') declarators | expr (',' expr)* )? ';' expr? ';' (expr (',' expr)*)? | ( annotation | 'final' )* (type | 'var') ident ':' expr ;
resources = resource (';' resource)* ';'? ;
resource = ( annotation | 'final' )* (type | 'var') ident '=' expr | chain ;
catch_param = ( annotation | 'final' )* type ('|' type)* ident ;
switch_body = ( ('case' labels | 'default') ':' statement* )* | ( ('case' labels | 'default') '->' ( expr ';' | @{block} | 'throw' expr ';' ) )* ;
labels = label (',' label)* ('when' expr)? ;
label = pattern | chain | 'default' ;
pattern = ( annotation | 'final' )* type ident | type @(pattern_list) ident? ;
pattern_list = (pattern (',' pattern)*)? ;
expr = place assign_op expr | chain | lambda ;
lambda = ( ident | @(params) | @(lambda_names) ) '->' ( expr | @{block} ) ;
lambda_names = (lambda_name (',' lambda_name)*)? ;
lambda_name = 'var'? ident ;
chain = operand op_rest* ;
op_rest = binop (operand | lambda) | '?' expr ':' expr | 'instanceof' 'final'? ( type | pattern ) ;
binop = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '<<' | '>' '='? | '>' '>' '>'? ;
operand = ( '+' | '-' | '++' | '--' | '!' | '~' | @(cast) )* primary tail* ('++' | '--')? ;
cast = type ('&' type)* ;
primary = ident | literal | 'this' | 'super' | @(test) | 'new' creator | 'switch' @(test) @{switch_body} | primitive dims ( '.' 'class' | '::' ('new' | ident) ) | class_type dims ( '.' 'class' | '::' type_args? ('new' | ident) ) | @(cast) lambda ;
literal = NUM | STR | CHAR | 'true' | 'false' | 'null' ;
tail = '.' type_args? ( ident | 'this' | 'class' | 'super' | 'new' creator ) | @(args) | @[test] | '::' type_args? ( ident | 'new' ) ;
creator = annotation* ( class_type @(args) @{class_body}? | (class_type | primitive) ( (annotation* @[test])+ dims | (annotation* @[nothing])+ @{array_init} ) ) ;
args = (expr (',' expr)*)? ;
any = ANY* ;
ident = NAME | 'var' | 'record' | 'sealed' | 'permits' | 'yield' | 'when' | 'module' | 'open' | 'non' ;
"""

RUST = r"""
file = HASHBANG? inner_attr* item* ;
inner_attr = '#' '!' @[any] ;
attrs = ('#' @[any])* ;
any = ANY* ;
items = inner_attr* item* ;
!item = attrs visibility? ( 'mod' ident (';' | @{items}) | 'extern' 'crate' (ident | 'self') ('as' ident)? ';' | 'use' use_tree ';' | function | 'type' ident generics? (':' bounds?)? where? ('=' type)? where? ';'
  | 'struct' ident generics? ( where? @{fields} | @(tuple_fields) where? ';' | where? ';' ) | 'union' ident generics? where? @{fields} | 'enum' ident generics? where? @{variants}
  | 'const' (ident | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? ident ':' type ('=' expr)? ';' | 'unsafe'? 'auto'? 'trait' ident generics? (':' bounds?)? where? @{assoc}
  | 'unsafe'? 'impl' generics? '!'? 'const'? type ('for' type)? where? @{assoc} | 'unsafe'? 'extern' STR? @{items} | macro_item ) ;
macro_item = path '!' ident? ( @{any} | @(any) ';' | @[any] ';' ) | 'macro' ident @(any)? @{any} ;
visibility = 'pub' @(vis_scope)? | 'crate' ;
vis_scope = 'crate' | 'self' | 'super' | 'in' path ;
use_tree = ('::'? (use_seg '::')*) ( '*' | @{use_list} | use_seg ('as' (ident | '_'))? ) ;
use_seg = ident | 'self' | 'super' | 'crate' ;
use_list = (use_tree (',' use_tree)* ','?)? ;
function = ('const' | 'async' | 'unsafe' | 'safe' | 'default' | 'extern' STR?)* 'fn' ident generics? @(params) ('->' type)? where? ( @{block} | ';' ) ;
params = (param (',' param)* ','?)? ;
param = attrs ( '&'? LIFETIME? 'mut'? 'self' (':' type)? | pattern ':' (type | '...') | '...' | '&' LIFETIME? 'mut'? 'self' ) ;
fn_type_params = (fn_type_param (',' fn_type_param)* ','?)? ;
fn_type_param = attrs ((ident | '_') ':')? type | '...' ;
generics = '<' (generic (',' generic)* ','?)? '>' ;
generic = attrs ( LIFETIME (':' bounds?)? | ident (':' bounds?)? ('=' type)? | 'const' ident ':' type ('=' (literal | @{block} | '-' literal | ident))? ) ;
bounds = bound ('+' bound)* '+'? ;
bound = LIFETIME | ('?' | 'const' | '~' 'const')? for_lifetimes? path | @(bound_group) | 'use' generic_args ;
bound_group = '?'? for_lifetimes? path ;
for_lifetimes = 'for' generics ;
where = 'where' (where_item (',' where_item)* ','?)? ;
where_item = LIFETIME ':' bounds? | for_lifetimes? type ':' bounds? ;
fields = (field (',' field)* ','?)? ;
field = attrs visibility? ident ':' type ('=' expr)? ;
tuple_fields = (attrs visibility? type (',' attrs visibility? type)* ','?)? ;
variants = (variant (',' variant)* ','?)? ;
variant = attrs visibility? ident ( @{fields} | @(tuple_fields) )? ('=' expr)? ;
assoc = inner_attr* (item)* ;
type = type_nobounds | ('impl' | 'dyn')? bounds ;
type_nobounds = path | '!' | '_' | '&' '&'? LIFETIME? 'mut'? type_nobounds | '*' ('const' | 'mut') type_nobounds | @[slice_type] | @(tuple_type) | for_lifetimes? ('unsafe' | 'extern' STR?)* 'fn' @(fn_type_params) ('->' type_nobounds)?
  | ('impl' | 'dyn') bound | '<' type ('as' path)? '>' ('::' path_seg)+ | path '!' ( @(any) | @[any] | @{any} ) ;
slice_type = type (';' expr)? ;
tuple_type = (type (',' type)* ','?)? ;
path = '::'? path_seg ('::' path_seg)* ;
path_seg = ( ident | 'self' | 'super' | 'crate' | 'Self' ) ( '::'? generic_args | @(fn_type_params) ('->' type_nobounds)? )? ;
generic_args = '<' (generic_arg (',' generic_arg)* ','?)? '>' ;
generic_arg = LIFETIME | type | ident generic_args? ( '=' type | ':' bounds ) | literal | '-' literal | @{block} ;
block = inner_attr* ( statement )* expr_attr? ;
expr_attr = attrs expr ;
!statement = ';' | item | attrs 'let' pattern (':' type)? ('=' expr ('else' @{block})?)? ';' | attrs expr ';' | attrs block_like | attrs path '!' @{any} ;
block_like = LIFETIME ':' block_like | ('unsafe' | 'const' | 'async' 'move'?)? @{block} | 'if' cond @{block} ('else' 'if' cond @{block})* ('else' @{block})? | 'match' cond @{arms} | 'loop' @{block} | 'while' cond @{block} | 'for' pattern 'in' cond @{block} ;
cond = expr ;
arms = inner_attr* ( arm )* last_arm? ;
!arm = attrs pattern ('if' expr)? '=>' ( expr ',' | block_like ','? ) ;
last_arm = attrs pattern ('if' expr)? '=>' expr ;
pattern = '|'? pat ('|' pat)* ;
pat = ident '@' pat | 'ref'? 'mut'? ident ('@' pat)? | '_' | '..' | '&' '&'? 'mut'? pat | @(pat_list) | @[pat_list] | path ( @(pat_list) | @{pat_fields} )? | qualified_path ( @(pat_list) | @{pat_fields} )? | range_end ( ('..=' | '..' | '...') range_end? )? | ('..=' | '..') range_end | 'box' pat | 'const' @{block} | path '!' ( @(any) | @[any] | @{any} ) ;
range_end = '-'? literal | path | qualified_path ;
pat_list = (pattern (',' later_pattern)* ','?)? ;
!later_pattern = pattern ;
pat_fields = (pat_field (',' pat_field)* ','?)? ;
pat_field = attrs ( '..' | (ident | NUM) ':' pattern | 'ref'? 'mut'? ident ) ;
qualified_path = '<' type ('as' path)? '>' ('::' path_seg)+ ;
expr = range ;
range = operand op_rest* | ('..' | '..=') ( operand op_rest* )? ;
op_rest = binop operand | 'as' type_nobounds | ('..' | '..=') operand? ;
binop = '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&' '&' | '||' | '==' | '!=' | '<' | '<' '<' | '<=' | '>' | '>' '>' | '>' '=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<=' | '>' '>' '=' ;
operand = ( '-' | '!' | '*' | '&' '&'? ('mut' | 'raw' ('const' | 'mut'))? )* ( 'let' pattern '=' operand | primary tail* | closure | jump ) ;
closure = for_lifetimes? ('static' | 'const' | 'async' | 'move')* ( '||' | '|' (closure_param (',' closure_param)* ','?)? '|' ) ( '->' type_nobounds @{block} | expr ) ;
closure_param = attrs pat (':' type)? ;
jump = 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | 'yield' expr? ;
tail = '.' ( ident ('::' generic_args)? | NUM | 'await' ) | @(args) | @[index] | '?' ;
primary = literal | path_expr @{struct_fields}? | path '!' ( @(any) | @[any] | @{any} ) | @(tuple) | @[array] | block_like | qualified_path @{struct_fields}? ;
path_expr = '::'? expr_seg ('::' expr_seg)* ;
expr_seg = ( ident | 'self' | 'super' | 'crate' | 'Self' ) ('::' generic_args)? ;
literal = NUM | STR | CHAR | 'true' | 'false' ;
struct_fields = (struct_field (',' struct_field)* ','?)? ;
struct_field = attrs ( (ident | NUM) (':' expr)? | '..' expr? ) ;
args = (expr_item (',' expr_item)* ','?)? ;
!expr_item = attrs expr ;
tuple = inner_attr* (expr_item (',' expr_item)* ','?)? ;
array = inner_attr* ( (expr_item (',' expr_item)* ','?)? | expr ';' expr ) ;
index = expr ;
ident = NAME | 'union' | 'auto' | 'default' | 'raw' | 'safe' | 'macro' ;
"""

CPP = r"""
file = items ;
items = ( item | ';' )* ;
!item = 'template' template_params item | 'template' declaration | 'extern' STR ( @{items} | item ) | 'inline'? 'namespace' attrs? ('inline'? ident ('::' 'inline'? ident)*)? attrs? @{items} | 'namespace' ident '=' qualified ';'
  | function | declaration | 'export' item | 'import' (NAME | STR | '.' | ':')+ ';' | 'export'? 'module' (NAME | '.' | ':')* ';' | macro_item | access ':' | 'concept' ident attrs? '=' expr ';' | 'asm' @(any) ';' ;
macro_item = NAME @(any) ';'? | NAME item ;
access = 'public' | 'private' | 'protected' | NAME ;
attrs = ( @[attr] | 'alignas' @(any) | '__attribute__' @(any) | '__declspec' @(any) )+ ;
attr = @[any] ;
any = ANY* ;
template_params = '<' (template_param (',' template_param)*)? '>' requires? ;
template_param = ('typename' | 'class' | 'template' template_params ('typename' | 'class')) '...'? ident? ('=' type_id)? | param ;
requires = 'requires' requires_expr ;
requires_expr = unary_req (('&&' | '||') unary_req)* ;
unary_req = '!'? ( qualified | @(args) | requires_block | 'true' | 'false' ) ;
requires_block = 'requires' @(params)? @{requirements} ;
requirements = ( expr ';' | 'typename' qualified ';' | @{single} 'noexcept'? ('->' type_id)? ';' | 'requires' expr ';' )* ;
single = expr ';'? ;
declaration = attrs? ( 'using' 'namespace' qualified ';' | 'using' 'enum'? 'typename'? qualified (',' qualified)* ';' | 'using' ident attrs? '=' type_id ';' | 'static_assert' @(args) ';' | 'friend' ( function | declaration | 'class'? qualified ';' )
  | specifiers ( declarator_init (',' declarator_init)* )? ';' | deduction ) ;
deduction = 'explicit'? ident @(params) '->' type_id ';' ;
specifiers = storage* type_spec storage* ;
storage = 'static' | 'extern' | 'inline' | 'constexpr' | 'consteval' | 'constinit' | 'const' | 'volatile' | 'virtual' | 'explicit' @(args)? | 'mutable' | 'typedef' | 'register' | 'thread_local' | 'friend' | attrs | '__extension__' ;
type_spec = builtin+ ( ('const' | 'volatile') builtin* )* | 'typename'? qualified | class_spec | enum_spec | 'auto' | 'decltype' @(args) ('::' qualified)? | qualified 'auto' | 'decltype' @(auto_only) ;
auto_only = 'auto' ;
builtin = 'int' | 'char' | 'bool' | 'float' | 'double' | 'void' | 'long' | 'short' | 'signed' | 'unsigned' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t' ;
class_spec = ('class' | 'struct' | 'union') attrs? NAME? qualified? 'final'? (':' base (',' base)*)? @{class_body} | ('class' | 'struct' | 'union') attrs? qualified ;
base = attrs? ('virtual' | 'public' | 'private' | 'protected')* qualified '...'? ;
enum_spec = 'enum' ('class' | 'struct')? attrs? qualified? (':' specifiers)? @{enumerators} | 'enum' ('class' | 'struct')? qualified (':' specifiers)? ;
enumerators = (enumerator (',' enumerator)* ','?)? ;
enumerator = ident attrs? ('=' expr_one)? ;
class_body = ( member | ';' )* ;
!member = item ;
function = attrs? storage* ( type_spec storage* declarator_fn | special_fn ) ctor_inits? ( @{block} | '=' ('default' | 'delete' | NUM) ';' | 'try' @{block} handler+ | ';' ) ;
special_fn = (qualified '::')? '~'? ident template_args? @(params) fn_suffix | (qualified '::')? 'operator' specifiers ptr* @(params) fn_suffix ;
declarator_fn = ptr* ( qualified | operator_name ) @(params) fn_suffix ;
operator_name = (qualified '::')? 'operator' ( binop | '!' | '~' | '++' | '--' | '->' | '->' '*' | @(nothing) | @[nothing] | ',' | 'new' @[nothing]? | 'delete' @[nothing]? | STR NAME? | 'co_await' ) ;
nothing = ;
fn_suffix = ( 'const' | 'volatile' | '&' | '&&' | 'noexcept' @(args)? | 'override' | 'final' | 'throw' @(any) | attrs | NAME )* ('->' type_id)? requires? ( 'override' | 'final' )* ;
ctor_inits = ':' ctor_init (',' ctor_init)* ;
ctor_init = qualified ( @(args) | @{init_list} ) '...'? ;
handler = 'catch' @(catch_param) @{block} ;
catch_param = '...' | attrs? specifiers declarator? ;
ptr = '*' | '&' | '&&' | 'const' | 'volatile' | 'restrict' | '__restrict' | qualified '::' '*' | attrs ;
declarator_init = declarator ( '=' init | @{init_list} | @(args) )? | declarator? ':' expr_one ('=' init | @{init_list})? ;
declarator = ptr* '...'? ( qualified attrs? | @(declarator_group) | @[bindings] )? ( @[index] | @[nothing] | @(params) fn_suffix )* ;
declarator_group = declarator ;
bindings = ident (',' ident)* ;
params = (param (',' param)* (','? '...')?)? | '...' ;
param = attrs? 'this'? specifiers '...'? declarator? ('=' init)? ;
type_id = attrs? specifiers abstract? '...'? ;
abstract = ptr+ abstract_tail* | abstract_tail+ ;
abstract_tail = @[index] | @[nothing] | @(params) fn_suffix | @(abstract_group) ;
abstract_group = ptr+ ;
qualified = '::'? seg ('::' 'template'? seg)* ;
seg = '~'? ident template_args? ;
template_args = '<' (template_arg (',' template_arg)*)? '>' ;
template_arg = type_id | expr_one '...'? ;
init = expr_one | @{init_list} ;
init_list = (init_item '...'? (',' init_item '...'?)* ','?)? ;
!init_item = ('.' ident)* '='? init | ('.' ident)+ @{init_list} | @[index] '=' init ;
block = ( statement )* ;
!statement = ';' | @{block} | 'if' ('constexpr' | '!'? 'consteval')? @(condition)? statement ('else' statement)? | 'while' @(condition) statement | 'do' statement 'while' @(condition) ';' | 'for' @(for_head) statement
  | 'switch' @(condition) statement | 'case' expr_one ('...' expr_one)? ':' statement? | 'default' ':' statement? | 'return' (expr | @{init_list})? ';' | 'co_return' expr? ';' | ('break' | 'continue') ';' | 'goto' ident ';'
  | 'try' @{block} handler+ | attrs? ident ':' statement? | attrs statement | declaration | expr ';' | 'template' template_params item | 'asm' 'volatile'? @(any) ';' | 'namespace' ident '=' qualified ';' ;
condition = (simple_init)? cond_expr ;
simple_init = declaration | expr? ';' ;
cond_expr = expr | attrs? specifiers declarator ( '=' init | @{init_list} ) ;
for_head = simple_init expr? ';' expr? | simple_init? attrs? specifiers declarator ':' init ;
expr = expr_one (',' later)* ;
!later = expr_one ;
expr_one = operand op_rest* | 'throw' expr_one? | 'co_yield' init ;
op_rest = binop ( operand | @{init_list} | 'throw' expr_one? ) | '?' expr? ':' (expr_one | @{init_list}) ;
binop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '&&' | '||' | '==' | '!=' | '<=>' | '<' | '<=' | '<<' | '>' '>'? ('=' | '==')? | '.*' | '->' '*' ;
operand = ( '+' | '-' | '*' | '&' | '!' | '~' | '++' | '--' | '&&' | 'co_await' | @(cast) )* ( postfix | 'sizeof' '...'? ( @(type_or_args) | operand ) | 'alignof' @(type_or_args) | 'noexcept' @(args) | new_expr | '::'? 'delete' @[nothing]? operand ) ;
cast = type_id ;
type_or_args = type_id | args ;
new_expr = '::'? 'new' @(args)? ( specifiers_new ptr* | @(cast) ) ( @[index] )* ( @(args) | @{init_list} )? ;
specifiers_new = storage* ( builtin+ | qualified | 'auto' ) ;
postfix = primary ( '.' 'template'? qualified | '.' operator_name | '->' 'template'? qualified | '->' operator_name | @(args) | @[index] | '++' | '--' | @{init_list} )* ;
primary = literal | 'this' | 'nullptr' | qualified | operator_name | @(args) | @(fold) | lambda | builtin+ ( @(args) | @{init_list} ) | 'typename' qualified ( @(args) | @{init_list} ) | 'auto' ( @(args) | @{init_list} ) | cast_kw '<' type_id '>' @(args) | 'typeid' @(type_or_args) | 'decltype' @(args) | requires_block | @(stmt_expr) ;
stmt_expr = @{block} ;
cast_kw = 'static_cast' | 'dynamic_cast' | 'reinterpret_cast' | 'const_cast' ;
literal = NUM | (STR NAME?)+ | CHAR | 'true' | 'false' ;
fold = operand op_rest* binop '...' (binop operand op_rest*)? | '...' binop operand op_rest* ;
lambda = @[captures] template_params? ( @(params) )? lambda_suffix @{block} ;
lambda_suffix = ( 'mutable' | 'constexpr' | 'consteval' | 'static' | 'noexcept' @(args)? | attrs )* ('->' type_id)? requires? ;
captures = (capture (',' capture)*)? ;
capture = '=' | '&' | 'this' | '*' 'this' | '&'? '...'? ident '...'? ( '=' init | @{init_list} | @(args) )? ;
args = ( arg (',' arg)* )? ;
arg = ( expr_one | @{init_list} | type_id ) '...'? ;
index = (expr_one | @{init_list}) (',' expr_one)* ;
ident = NAME | 'final' | 'override' | 'module' | 'import' ;
"""

# What may stand between a documentation comment and its declaration, and the functions that are searched for in broken files.
_METHOD = "modifier* ('get' | 'set')? 'async'? '*'? (prop_name | PRIVATE) '?'? type_params? @(params) return_type? @{block_items}"
PREFIXES = {
    name: f"prefix = (decorators NL* | modifier | 'export' | 'default' | 'async')* ; island = ('export' 'default'?)? 'async'? 'function' '*'? ident? type_params? @(params) return_type? @{{block_items}} ; island_method = {_METHOD} ;"
    for name in ("javascript", "typescript")
} | {
    "java": "prefix = modifiers ; island = ( 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'strictfp' | 'default' )* type_params? ( type ident @(params) dims throws? @{block} | ident @(params) throws? @{block} ) ;",
    "rust": "prefix = attrs visibility? ; island = visibility? function ;",
    "cpp": "prefix = ('template' template_params | attrs | storage)* ; island = storage* ( type_spec storage* declarator_fn | special_fn ) ctor_inits? ( @{block} | 'try' @{block} handler+ ) ;",
    "go": "prefix = ; declarations = (top ';')* ; island = function ;",
    "python": "prefix = NL* ; island = funcdef ;",
}
