"""Trees of broken tables, selects and templates, as the rules of the public standard give them."""
import pytest

from domframe.operators import html


def shown(page: str) -> str:
    """Children of body as tag(children), texts in quotes."""

    def one(n: html.Node) -> str:
        return f"'{n.text}'" if n.tag == html.TEXT else n.tag + (f"({' '.join(map(one, n.children))})" if n.children else "")

    root = html.parse(page)
    body = next(n for n in root.children if n.tag == "body")
    for n in [root, *root.children]:
        assert all(c.parent is n for c in n.children)
    return " ".join(map(one, body.children))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<table><tr>x<td>1", "'x' table(tbody(tr(td('1'))))"),
        ("<table>a<tr>b<td>c</td>d", "'abd' table(tbody(tr(td('c'))))"),
        ("<p>q<table> <tr> <td>1", "p('q') table(' ' tbody(tr(' ' td('1'))))"),
        ("<table><div>x</div><tr><td>y", "div('x') table(tbody(tr(td('y'))))"),
        ("<table><b>x<tr><td>y</table>z", "b('x') table(tbody(tr(td('y')))) b('z')"),
        ("<table><td>a<td>b<tr><th>c", "table(tbody(tr(td('a') td('b')) tr(th('c'))))"),
        ("<table><thead><tr><th>a<tbody><td>b<tfoot><tr><td>c", "table(thead(tr(th('a'))) tbody(tr(td('b'))) tfoot(tr(td('c'))))"),
        ("<table><caption>t<tr><td>1", "table(caption('t') tbody(tr(td('1'))))"),
        ("<table><col><col><tr><td>1", "table(colgroup(col col) tbody(tr(td('1'))))"),
        ("<table><colgroup> <col>x<tr><td>1", "'x' table(colgroup(' ' col) tbody(tr(td('1'))))"),
        ("<table><tr><td><table><tr><td>in</table>out", "table(tbody(tr(td(table(tbody(tr(td('in')))) 'out'))))"),
        ("<table><tr><table><tr><td>2", "table(tbody(tr)) table(tbody(tr(td('2'))))"),
        ("<table><tr><td><b>x</td><td>y</td></tr></table>z", "table(tbody(tr(td(b('x')) td('y')))) 'z'"),
        ("<table><tr><td>1</tr></td></tbody>x</table>y", "'x' table(tbody(tr(td('1')))) 'y'"),
        ("<table><input type=hidden><input><tr><td>1", "input table(input tbody(tr(td('1'))))"),
        ("<table><script>s</script><tr><td>1", "table(script('s') tbody(tr(td('1'))))"),
        ("<td>1</td><tr>2</tr>", "'12'"),
        ("<div><td>1</div>2", "div('1') '2'"),
        ("<a>1<table><a>2</table>", "a('1' a('2') table)"),
        ("<select><option>1<option>2<optgroup><option>3</optgroup><div>4</div></select>5", "select(option('1') option('2') optgroup(option('3')) '4') '5'"),
        ("<select>1<select>2", "select('1') '2'"),
        ("<select><option>1<input>2", "select(option('1')) input '2'"),
        ("<table><tr><td><select><option>1<td>2", "table(tbody(tr(td(select(option('1'))) td('2'))))"),
        ("<table><tr><td><select>1</table>2", "table(tbody(tr(td(select('1'))))) '2'"),
        ("<template><td>1</td><td>2</template>3", "template(td('1') td('2')) '3'"),
        ("<template><tr><td>1</template>3", "template(tr(td('1'))) '3'"),
        ("<template><div>1<td>2</div>", "template(div('12'))"),
        ("<table><template><tr><td>1</template><tr><td>2", "table(template(tr(td('1'))) tbody(tr(td('2'))))"),
        ("<p>1<table></p>2", "p('1') p '2' table"),
        ("<table><tr><td>a</td> <td>b</td> </tr> </table>", "table(tbody(tr(td('a') ' ' td('b') ' ') ' '))"),
        ("<b><table><td></b>x</td></table>y", "b(table(tbody(tr(td('x')))) 'y')"),
        ("<ul><li>1<table><li>2</table><li>3", "ul(li('1' li('2') table) li('3'))"),
    ],
)
def test_trees(page, want):
    assert shown("<body>" + page) == want
